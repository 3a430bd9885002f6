"""Queries: operators put together over tables."""
