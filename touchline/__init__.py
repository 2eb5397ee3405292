"""Match-tracking analytics as Spark DataFrame and Structured Streaming jobs."""
