"""Price intelligence and product linking as Spark DataFrame jobs."""
