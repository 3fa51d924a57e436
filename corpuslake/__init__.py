"""corpuslake: preparing and evaluating text-embedding data as Spark jobs."""
