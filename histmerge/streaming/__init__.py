"""Incremental merging with Structured Streaming."""
