"""pointweave: point-level perception analytics as lazy Spark DataFrame plans."""
