"""Operators over DataFrames of records."""
