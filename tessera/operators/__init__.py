"""Operators over the knowledge base's tables. Each takes and returns DataFrames."""
