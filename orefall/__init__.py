"""Evidence retrieval, evaluation and training-data analytics as Spark DataFrame transformations."""
