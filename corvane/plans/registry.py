"""All queries of the library outside the training-data subpackage."""

from __future__ import annotations

from . import q_corpus, q_eval, q_files, q_search, q_stream, q_tables
from .views import ORACLE_SQL, QUERIES

MODULES = (q_corpus, q_files, q_search, q_tables, q_eval, q_stream)


def flagship(spark, sf_dir):
    return QUERIES["hybrid_search"](spark, sf_dir)


__all__ = ["MODULES", "ORACLE_SQL", "QUERIES", "flagship"]
