"""Entity mining, result ranking, record quality and learning analytics on Spark DataFrames."""
