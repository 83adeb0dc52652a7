"""Searches for streams of queries."""
