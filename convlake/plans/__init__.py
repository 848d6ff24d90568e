"""Registered queries and their SQL, over the driver's tables."""
