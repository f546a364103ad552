"""inkwell: full-text search and document analytics expressed as Spark DataFrames."""
