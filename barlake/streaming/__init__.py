"""Structured Streaming operators for ticks."""
