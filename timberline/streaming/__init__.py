"""Structured Streaming: continuous ingest and alert state."""
