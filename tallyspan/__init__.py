"""tallyspan: observation analytics and training-data operators on PySpark."""
