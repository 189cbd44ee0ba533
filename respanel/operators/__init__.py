"""Operators on response matrices; every function takes and returns DataFrames."""
