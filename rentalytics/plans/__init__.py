"""Whole analyses and pipelines composed from the operators."""
