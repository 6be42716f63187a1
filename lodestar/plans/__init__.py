"""Composed queries over the parquet tables."""

from . import q_facts, q_graph, q_pool, q_retrieval, q_text, q_vault, q_views  # noqa: F401  they register their queries
from .q_retrieval import search_notes
from .views import notes


def flagship(spark, sf_dir):
    """search_notes with titles."""
    titles = notes(spark, sf_dir).selectExpr("id as key", "title")
    return search_notes(spark, sf_dir).join(titles, "key")
