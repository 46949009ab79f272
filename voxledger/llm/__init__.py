"""Training-data operators: ten corpus operators built on Spark DataFrames."""
