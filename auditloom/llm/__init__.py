"""Operators that turn crawled documents into training data. Nothing outside this folder imports them."""
