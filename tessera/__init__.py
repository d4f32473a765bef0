"""tessera: corpus analytics as plain Spark DataFrame transformations."""
