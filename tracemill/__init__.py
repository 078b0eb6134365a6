"""Session-trace analytics as Spark DataFrame operators."""
