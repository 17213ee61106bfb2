"""Streaming forms of the event log and of the upserts."""
