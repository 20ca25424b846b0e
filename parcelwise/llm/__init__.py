"""Operators for preparing training data; see ``entry`` for the queries built from them."""
