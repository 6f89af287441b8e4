"""Listing analytics expressed as Spark DataFrame plans."""
