"""Structured Streaming forms of the query service and of resumed work."""
