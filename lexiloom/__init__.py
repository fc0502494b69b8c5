"""Token, palette and archive analytics on Spark."""
