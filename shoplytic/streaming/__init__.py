"""Sales figures kept up to date by Structured Streaming."""
