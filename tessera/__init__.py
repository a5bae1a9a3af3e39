"""tessera: raster-to-point analytics on Spark DataFrames."""
