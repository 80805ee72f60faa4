"""Composite jobs: named DataFrames built from the operators."""
