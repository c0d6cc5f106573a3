"""Point-in-time time-series analytics on PySpark."""
