"""Part of ledgerline: operators."""
