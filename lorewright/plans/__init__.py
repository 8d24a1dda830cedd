"""Registered queries over the driver's tables."""

from . import analytics, books, calendar, files, manuals, outputs, records, registry, rules, search, streams, structure, texts, token_streams  # noqa: F401
