"""Sensitive-text analytics on Spark: detection, masking, restoration, audit."""
