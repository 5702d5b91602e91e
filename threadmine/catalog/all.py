"""Import this module to register every query."""

from threadmine.catalog import (  # noqa: F401
    conversation_queries,
    curation_queries,
    log_queries,
    search_queries,
    streaming_queries,
    text_queries,
)
from threadmine.catalog.registry import ORACLES, QUERIES  # noqa: F401
