"""Snapshots, wire formats and sinks."""
