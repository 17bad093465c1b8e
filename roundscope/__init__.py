"""Round-completeness analytics on Spark: DataFrame and Structured Streaming operators."""
