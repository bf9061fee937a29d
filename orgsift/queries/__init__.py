"""The registered queries by family."""

from . import q_dedup, q_learning, q_pages, q_quality, q_search, q_text  # noqa: F401
from .q_pages import best_link_per_page as flagship  # noqa: F401
from .registry import QUERIES, SQL


def all_queries():
    return dict(QUERIES)


def all_sql():
    return dict(SQL)
