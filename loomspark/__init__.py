"""A Spark-first engine for building, cleaning and auditing text corpora."""
