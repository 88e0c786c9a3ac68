"""Job-market demand and skill-gap analysis as Spark jobs."""
