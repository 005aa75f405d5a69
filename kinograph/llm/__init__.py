"""Corpus operators for training-data pipelines.

Self-contained: nothing else in the package imports this subpackage, and it
imports nothing from the rest of the package.
"""
