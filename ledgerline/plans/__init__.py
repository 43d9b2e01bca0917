"""Part of ledgerline: plans."""
