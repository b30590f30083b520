"""Where users' models plug in: pandas UDFs over columns of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_embedder(df: DataFrame, embed: Callable, text: str = "text", out: str = "embedding", identity: str | None = None) -> DataFrame:
    """Adds vectors of ``text``; ``embed`` is a pandas UDF from string to array of floats.

    Null texts are not embedded.  ``identity`` names the model in ``embedder_identity``.
    """
    done = df.withColumn(out, F.when(F.col(text).isNotNull(), embed(F.coalesce(F.col(text), F.lit("")))))
    return done if identity is None else done.withColumn("embedder_identity", F.when(F.col(out).isNotNull(), F.lit(identity)))


def with_pair_scorer(pairs: DataFrame, score: Callable, query: str = "query", text: str = "text") -> DataFrame:
    """(query_id, chunk_id, pair_score) for rerank_with_scores; ``score`` is a pandas UDF of two strings."""
    return pairs.select("query_id", "chunk_id", score(F.col(query), F.col(text)).cast("double").alias("pair_score"))


def with_generator(df: DataFrame, generate: Callable, prompt: str = "prompt", out: str = "raw") -> DataFrame:
    """Adds generated text; ``generate`` is a pandas UDF from string to string."""
    return df.withColumn(out, generate(F.col(prompt)))
