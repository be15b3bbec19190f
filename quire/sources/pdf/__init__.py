"""Reading and writing PDF bytes: pure Python, no Spark."""
