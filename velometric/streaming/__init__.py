"""Incremental pick-up of new source files."""
