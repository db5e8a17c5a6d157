"""Operators that prepare a training corpus."""
