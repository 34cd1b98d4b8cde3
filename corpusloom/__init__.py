"""Dictionary retrieval and corpus preparation as set-at-a-time Spark jobs."""
