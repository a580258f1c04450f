"""Artwork conformance analytics expressed as Spark queries."""
