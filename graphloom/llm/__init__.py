"""Operators for large text corpora: one module for each operator, ``queries`` for the registered ones."""
