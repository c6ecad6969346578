"""Operators for preparing training data: ten methods and the corpus pipeline over them."""
