"""Structured Streaming forms of result intake and evidence windows."""
