"""Expression-first functional datasets on Spark DataFrames."""
