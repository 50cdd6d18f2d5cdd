"""Bounded-memory ingestion with Structured Streaming."""
