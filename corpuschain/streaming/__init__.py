"""Structured Streaming over events: an extension, since the reference has no streams."""
