"""Operators over DataFrames, grouped by what they do."""
