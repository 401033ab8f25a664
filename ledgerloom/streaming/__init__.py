"""The background jobs as Structured Streaming."""
