"""Security-event analytics and training-data operators on PySpark."""
