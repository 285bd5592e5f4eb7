"""The operators over streams of events."""
