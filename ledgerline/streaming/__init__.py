"""Snapshots over streams."""
