from . import ingest_queries, log_queries, text_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
