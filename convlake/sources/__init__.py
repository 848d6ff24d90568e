"""Export readers: provider files to ledger tables."""
