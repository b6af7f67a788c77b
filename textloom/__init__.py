"""textloom: positional text indexes, ranked search and text analytics as Spark DataFrames."""
