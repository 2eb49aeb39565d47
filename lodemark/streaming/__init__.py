"""Lodemark streaming."""
