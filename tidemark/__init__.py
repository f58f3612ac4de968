"""Tidemark: dependency-drift analytics and data-processing operators on Spark DataFrames."""
