"""Daily digests from many content sources, as Spark jobs."""
