"""Structured Streaming forms of the queue consumers and of the keyed state."""
