"""respanel: response-matrix analytics on Spark DataFrames."""
