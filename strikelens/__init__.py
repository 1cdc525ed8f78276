"""Option and futures positioning analytics as PySpark DataFrame jobs."""
