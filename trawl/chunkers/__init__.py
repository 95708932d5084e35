"""Splitters of one file's text into chunks; sequential by nature, so plain Python run by Spark."""
