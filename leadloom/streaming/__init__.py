"""Structured Streaming forms of the queue and of the event windows."""
