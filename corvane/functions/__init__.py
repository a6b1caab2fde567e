"""Scalar functions: IDs, page tokens and encoders."""
