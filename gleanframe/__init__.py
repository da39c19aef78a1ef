"""Survey and mention analytics as PySpark DataFrame operators."""
