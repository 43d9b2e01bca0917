"""Provenance-tracked research analytics on Spark."""
