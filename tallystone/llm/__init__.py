"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it, and it imports nothing from the
rest of the library, so either side can be removed.
"""
