"""General operators: DataFrames in, DataFrames out."""
