"""Operators that prepare corpora for training. Nothing else in the library imports this subpackage."""
