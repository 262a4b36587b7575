"""Statements as DataFrames: SELECT, INSERT, UPDATE, DELETE, and what defines tables."""
