"""factloom: point-in-time content facts on Spark DataFrames."""
