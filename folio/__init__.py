"""Document analytics on Spark: lightweight-markup text in, queryable DataFrames out."""
