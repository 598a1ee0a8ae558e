"""Merge, lookup, numbering and checking operators on DataFrames."""
