"""Merging related tables that have their own ids, as Spark DataFrames."""
