"""Literary text analytics on Spark."""
