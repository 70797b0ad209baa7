"""Structured Streaming: progress logs that are replayed, series that are merged, event counts."""
