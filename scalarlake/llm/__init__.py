"""Operators for building training data out of documents and web pages."""
