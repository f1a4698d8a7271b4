"""glossa: declarative text analytics on PySpark."""
