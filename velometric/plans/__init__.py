"""Whole-table plans built from the operators."""
