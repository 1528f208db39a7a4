"""Readers, sinks, keyed upserts and run records."""
