"""City-map, dialogue and training-data jobs as Spark DataFrames."""
