"""Imports every entry module, which fills the registry."""

from dayrunner.catalog import (  # noqa: F401
    entries_answers,
    entries_joins,
    entries_metrics,
    entries_sequences,
    entries_sources,
    entries_spatial,
    entries_text,
    entries_views,
)
