"""barloom: market time series analytics as Spark DataFrames."""
