"""Environmental sensor panels and training-data operators as Spark jobs."""
