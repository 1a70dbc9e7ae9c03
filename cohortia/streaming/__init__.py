"""Structured Streaming extensions; the batch engine does not need them."""
