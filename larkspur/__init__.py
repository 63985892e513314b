"""Analytics on curated listings, and operators for training data, on Spark."""
