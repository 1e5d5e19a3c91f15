"""Operators: each takes DataFrames and parameters and gives a DataFrame."""
