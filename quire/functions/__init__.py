"""Quire functions."""
