"""Document-verification and corpus analytics on Spark."""
