"""Environmental-monitoring analytics as plain PySpark DataFrame operators."""
