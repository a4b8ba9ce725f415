"""barloom: factor analytics for OHLCV bars, declared as Spark DataFrames."""
