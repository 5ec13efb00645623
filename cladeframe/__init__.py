"""cladeframe: similarity-network and orthology analytics on Spark DataFrames."""
