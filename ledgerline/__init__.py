"""Stock-keeping event analytics as Spark DataFrame operators."""
