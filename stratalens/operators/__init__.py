"""Operators over images, layers, fingerprints and archives as DataFrames."""
