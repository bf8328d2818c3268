"""Query registry: what __spark_entry__ serves."""
