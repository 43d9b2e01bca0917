"""Part of ledgerline: sources."""
