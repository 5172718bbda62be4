"""Snapshot reconciliation and guarded repair on Spark."""
