"""Operators on DataFrames: retrieval, statistics, sampling, features, ranking and checks."""
