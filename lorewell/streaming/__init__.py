"""Structured Streaming: log replay with keyed state, incremental indexing of arriving files."""
