"""Spark-native text de-identification; ``veilspark.llm`` holds the separate training-data operators."""
