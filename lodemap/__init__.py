"""Graph, text and change analytics on Spark."""
