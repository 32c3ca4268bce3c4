"""Flight-delay analytics expressed over Spark DataFrames."""
