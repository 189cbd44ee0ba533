"""Readers of graded answers: JSON lines, delimited text, sample logs, run directories."""
