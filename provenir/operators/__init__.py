"""Operators on DataFrames of any source."""
