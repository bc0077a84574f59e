"""Article enrichment and reader-preference analytics as Spark jobs."""
