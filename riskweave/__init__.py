"""Text-risk analytics on Spark."""
