"""Structured Streaming over event tables: an extension beyond batch datasets."""
