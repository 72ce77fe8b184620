"""Point-in-time, cross-sectional panel analytics written as Spark DataFrame transformations."""
