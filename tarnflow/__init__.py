"""tarnflow: a Spark-first analytical knowledge base and data-processing engine."""
