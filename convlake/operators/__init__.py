"""Relational and analytic operators over the ledger tables."""
