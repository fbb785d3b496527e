"""Retention operators: DataFrames in, DataFrame out; times, windows and thresholds are arguments."""
