"""Street-network safety analytics expressed as Spark DataFrame operators."""
