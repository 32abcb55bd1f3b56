"""splicewell: chimeric-read junction analytics and training-data operators on PySpark."""
