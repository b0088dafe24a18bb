"""Query-aware analytics on Spark."""
