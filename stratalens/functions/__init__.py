"""Scalar functions: references, sizes, errors, digests, codecs, signatures."""
