"""Entity-by-year panel analytics on Spark DataFrames."""
