"""Corpus preparation and analytics expressed as Spark DataFrame plans."""
