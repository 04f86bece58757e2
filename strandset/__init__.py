"""strandset: read phasing and interval analytics on Spark DataFrames."""
