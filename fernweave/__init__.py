"""fernweave: retrieval and text analytics over Spark DataFrames."""
