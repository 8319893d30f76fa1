"""Structured change on DataFrames: diff, apply, merge and converge tables of nested values."""
