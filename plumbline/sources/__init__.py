"""Readers: market tables derived from the given tables, vendor formats, snapshots."""
