"""Query catalogue: named Spark jobs and their independent SQL twins."""
