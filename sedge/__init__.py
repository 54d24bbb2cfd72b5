"""sedge: sustainability and policy analytics on Spark DataFrames."""
