"""Ride transformations: DataFrame in, lazy DataFrame out."""
