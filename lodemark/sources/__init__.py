"""Lodemark sources."""
