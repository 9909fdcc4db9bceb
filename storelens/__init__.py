"""Store insights from saved web pages and product feeds, as Spark jobs."""
