"""Structured Streaming twins of the stateful operators; the same rules, in event time."""
