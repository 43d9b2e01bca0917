"""Part of ledgerline: functions."""
