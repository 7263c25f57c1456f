"""Analytics over price observations, declared as Spark DataFrames."""
