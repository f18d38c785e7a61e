"""Whole pipelines and the named queries built from the operators."""
