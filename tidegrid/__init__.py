"""Keyed sensor time-series analytics as plain ``DataFrame -> DataFrame`` functions."""

__version__ = "0.1.0"
