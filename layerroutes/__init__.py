"""State-trajectory analytics on PySpark."""
