"""Lodemark operators."""
