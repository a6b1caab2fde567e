"""Mirrors that follow a change log with Structured Streaming."""
