"""Japanese text analysis as Spark DataFrames."""
