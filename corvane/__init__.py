"""Corvane: estimation, evaluation, matrix, grid and time-series operators for Spark DataFrames."""
