"""Product-funnel analytics on Spark DataFrames."""
