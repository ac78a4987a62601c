"""Media-catalogue analytics expressed as lazy Spark DataFrame transformations."""
