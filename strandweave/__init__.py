"""strandweave: sequence-path analytics on Spark DataFrames."""
