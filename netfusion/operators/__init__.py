"""Relational, graph and text operators: pure functions from DataFrames to DataFrames."""
