"""Customer and complaint analytics as PySpark DataFrame jobs."""
