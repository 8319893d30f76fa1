"""Operators on snapshots and operation tables."""
