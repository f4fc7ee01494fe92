"""Incremental and event-time processing."""
