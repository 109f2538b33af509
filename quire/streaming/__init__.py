"""Quire streaming."""
