"""A facility-registry analytics engine on PySpark."""
