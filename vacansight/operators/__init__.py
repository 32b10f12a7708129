"""Query operators: DataFrames in, one DataFrame out."""
