"""Joins, aggregates, windows and batch operators on DataFrames."""
