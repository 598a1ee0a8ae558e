"""Operators of a training-data pipeline: ten operators and the pipeline's queries."""
