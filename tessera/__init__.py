"""Text annotation and pattern queries as Spark DataFrames."""
