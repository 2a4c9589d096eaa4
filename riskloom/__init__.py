"""Portfolio risk analytics on Spark: governed ingestion, positions, valuation, risk, and serving."""
