"""Analytics over corpora of graphics-API trace logs, as plain Spark DataFrames."""
