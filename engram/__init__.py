"""engram: memory analytics on PySpark."""
