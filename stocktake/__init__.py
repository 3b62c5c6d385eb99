"""Reconciling a catalog of expected items with an inventory of what is there, on Spark."""
