"""Document analytics on Spark: declarative pipelines over captured text collections."""
