"""Relational operators, statistics and readers for biological and tabular data, on Spark DataFrames."""
