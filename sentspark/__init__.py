"""Text-corpus preparation, sentence vectors and vector search as Spark jobs."""
