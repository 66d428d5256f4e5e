"""The document operators over streams."""
