"""Scalar and array expressions that the operators share."""
