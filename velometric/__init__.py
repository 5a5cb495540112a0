"""Bike-share ride analytics as lazy Spark DataFrame transformations."""

__all__ = ["functions", "operators", "plans", "sinks", "sources", "streaming"]
