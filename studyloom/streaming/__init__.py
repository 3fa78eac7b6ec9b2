"""Structured Streaming forms of the cleaning, grouping and resume jobs."""
