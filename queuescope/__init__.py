"""Queue-state analytics on Spark: interval, event and model-comparison operators over DataFrames."""
