"""barloom: market time-series analytics and training-data operators on PySpark."""
