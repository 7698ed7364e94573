"""Operators for preparing training text and vectors; see ``queries`` for the registered ones."""
