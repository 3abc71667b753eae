"""Object-graph analytics on Spark."""
