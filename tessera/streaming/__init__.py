"""Structured Streaming over the fact store's event logs: an extension, not parity."""
