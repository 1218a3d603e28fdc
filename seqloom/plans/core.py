"""All core queries in one place."""

from . import build_queries, io_queries, model_queries, relation_queries, score_queries, sequence_queries, table_queries, vector_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
