"""Record and document analytics on Spark DataFrames."""
