"""Source and text analysis as Spark jobs."""
