"""siltstone: concept mining over document collections, on Spark DataFrames."""
