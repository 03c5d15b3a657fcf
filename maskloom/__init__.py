"""A Spark engine that finds and masks personal information in text tables."""
