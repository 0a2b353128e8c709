"""siltline: conversation analytics and training-data operators as PySpark jobs."""
