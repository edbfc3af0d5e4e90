"""Communication-trace analytics expressed as Spark DataFrame jobs."""
