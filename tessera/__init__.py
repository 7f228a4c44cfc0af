"""Tessera: timed-text and training-data analytics on Spark."""
