"""Analytics over financial account statements, as lazy Spark DataFrames."""
