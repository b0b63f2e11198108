"""Scalar functions: text, phonetics, numbers, dates and identifiers."""
