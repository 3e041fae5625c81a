"""Service-desk analytics as Spark DataFrame operators."""
