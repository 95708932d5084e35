"""Indexes as immutable snapshots, their maintenance, and search over them."""
