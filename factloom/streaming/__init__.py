"""Structured Streaming jobs: retry state machines and idempotent sinks."""
