"""Operators of a training-data pipeline: search, tokens, dedup, scoring and packing.

Nothing else in the library imports this subpackage.  Every operator takes DataFrames and
column names, never paths, and leaves the choice of storage to the caller.
"""
