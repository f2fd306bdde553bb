"""sparkfold: metadata records merged, derived and matched as Spark DataFrames."""
