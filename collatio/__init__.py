"""Witness-matrix analytics on Spark: compare many versions of one text at scale."""

__version__ = "0.1.0"
