"""Scalar functions on columns: text, urls, codecs, dates, stemming."""
