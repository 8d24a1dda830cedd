"""Operators for preparing training text at corpus scale. Nothing outside this package imports it."""
