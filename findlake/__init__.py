"""Findings analytics on Spark: declarative extraction, identity, matching, policy and measurement."""

__version__ = "0.1.0"
