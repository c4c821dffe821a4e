"""Operators: reports, curves, sampling, joins and exact quantiles over Spark DataFrames."""
