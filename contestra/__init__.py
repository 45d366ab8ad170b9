"""Contest analytics and training-data preparation as composable Spark DataFrame operators."""
