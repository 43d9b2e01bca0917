"""Part of ledgerline: streaming."""
