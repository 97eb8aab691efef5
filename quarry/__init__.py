"""Code-intelligence and usage analytics on Spark."""
