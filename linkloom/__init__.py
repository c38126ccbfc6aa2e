"""Document link analytics as Spark DataFrames."""
