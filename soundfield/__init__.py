"""Urban-noise analytics on Spark DataFrames."""
