"""Continuous syncs: file listings and logs as streams."""
