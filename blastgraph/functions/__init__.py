"""Scalar functions: versions, times, package coordinates, edit distance."""
