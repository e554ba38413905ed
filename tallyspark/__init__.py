"""Token-usage analytics as PySpark DataFrame jobs."""
