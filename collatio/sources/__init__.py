"""Readers that turn files into ordered segment DataFrames."""
