"""Structured Streaming forms of the append-only parts."""
