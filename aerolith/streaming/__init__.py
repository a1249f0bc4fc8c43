"""Structured Streaming forms of the hourly and daily aggregates, sessions and idempotent sinks."""
