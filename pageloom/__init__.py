"""Document extraction and text analytics on Spark."""
