"""Placing streams of documents in topics, and counting streams of events."""
