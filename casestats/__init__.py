"""Case-file analytics on Spark."""
