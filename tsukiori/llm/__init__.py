"""Operators for preparing training text. Nothing else in the library imports this.

Tasks import this package by name, so a cluster needs it on its workers
(``--py-files`` or an installed package).
"""
