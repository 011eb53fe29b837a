"""Claim verification over tabular evidence as Spark DataFrames."""
