"""Operators on bars: each takes and returns DataFrames."""
