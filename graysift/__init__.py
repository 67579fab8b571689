"""Personal-data scanning and training-data preparation as Spark jobs."""
