"""Rates of a stream of graded answers."""
