"""Reading, checking and publishing history tables."""
