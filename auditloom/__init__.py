"""Report anomaly analytics as Spark jobs."""
