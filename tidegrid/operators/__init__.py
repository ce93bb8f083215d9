"""Operators: ``DataFrame -> DataFrame`` functions on keyed series."""
