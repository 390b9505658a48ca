"""Topologies over Structured Streaming."""
