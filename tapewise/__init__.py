"""Point-in-time market research operators on Spark DataFrames."""
