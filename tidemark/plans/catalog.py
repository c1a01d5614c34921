"""All registered queries; importing the modules fills the registry."""

from tidemark.plans import (  # noqa: F401
    queries_events,
    queries_filings,
    queries_identity,
    queries_models,
    queries_panel,
    queries_pit,
    queries_readers,
    queries_sources,
    queries_stats,
    queries_text,
)
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
