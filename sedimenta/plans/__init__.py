"""Bindings of the operators to the test tables."""
