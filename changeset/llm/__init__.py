"""Training-data operators: the ten components of a large-scale corpus pipeline.

Nothing else in the library imports this subpackage; it imports nothing of the
rest either, so both can be used and removed on their own.
"""
