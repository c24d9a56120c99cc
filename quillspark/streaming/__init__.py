"""Structured Streaming shapes of the polling loaders."""
