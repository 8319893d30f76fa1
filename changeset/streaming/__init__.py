"""Replica state kept by Structured Streaming."""
