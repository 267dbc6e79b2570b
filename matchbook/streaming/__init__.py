"""Structured Streaming forms of the time-stateful operators."""
