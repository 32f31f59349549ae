"""docloom: document analytics as composable Spark DataFrame operators."""
