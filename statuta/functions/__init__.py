"""Scalar functions on columns: text, dates, urls and Chinese numerals."""
