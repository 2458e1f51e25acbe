"""Point-in-time equity screening as Spark DataFrame operators."""
