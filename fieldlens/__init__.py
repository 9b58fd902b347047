"""Identity-resolution analytics on PySpark."""
