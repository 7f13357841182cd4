"""Operators for preparing training data: one module per operator, plus ``queries``.

Nothing outside this folder imports it, so it can be removed without touching the rest of the library.
"""
