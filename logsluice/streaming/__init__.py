"""Structured Streaming forms of the ordered operators and the sinks."""
