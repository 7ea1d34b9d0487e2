"""All queries of the library with their SQL."""

from . import channels, extras, frames, helpers, kernels, logs, media, rules, sequences, services, shapes, texts

QUERIES: dict = {}
SQL: dict = {}
for _part in (channels, extras, frames, helpers, kernels, logs, media, rules, sequences, services, shapes, texts):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
