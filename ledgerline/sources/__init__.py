"""Readers of transaction files, stored tables, and stand-ins built from other tables."""
