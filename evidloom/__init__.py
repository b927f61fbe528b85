"""Evidence matching, quality and demand analytics as Spark DataFrame plans."""
