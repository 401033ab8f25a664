"""Composed flows and the queries over the driver tables."""
