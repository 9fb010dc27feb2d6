"""Structured Streaming: an extension beside the batch operators."""
