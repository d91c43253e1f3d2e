"""Record pipelines and corpus operators as plain Spark DataFrame transformations."""
