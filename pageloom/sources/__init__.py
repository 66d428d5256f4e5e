"""Reading bodies: bytes to text, size limits, request addresses."""
