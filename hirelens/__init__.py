"""Job-market analytics as Spark DataFrame jobs."""
