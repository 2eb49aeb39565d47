"""Lodemark functions."""
