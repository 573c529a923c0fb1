"""Operators for preparing training text; nothing else in this library imports them."""
