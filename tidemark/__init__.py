"""tidemark: Spark-first factor analytics for market-microstructure time series."""
