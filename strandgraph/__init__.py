"""Traceability analytics on Spark."""
