"""Stemma: bibliographic record linkage, classification and density analytics on Spark."""
