"""Batch scorers: model calls as functions from DataFrame to DataFrame.

A model plugs in as ``with_batches(fn, schema)``: ``fn`` maps one pandas batch to
one pandas batch inside ``mapInPandas``.  The defaults here need no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.answers import groundedness_gate, resolved_query
from foliant.functions.text import tokens
from foliant.operators.fusion import ngram_groundedness, sentence_overlap_answer


def with_batches(fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Callable[[DataFrame], DataFrame]:
    """Turn a per-batch pandas function into a scorer; the function is set up once per Python worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return lambda df: df.mapInPandas(run, schema)


def hashed_embeddings(df: DataFrame, text: str = "text", dims: int = 256, out: str = "embedding",
                      fitted: IDF | None = None) -> DataFrame:
    """Unit-length tf-idf vectors over hashed terms (stand-in for an embedding model)."""
    words = df.withColumn("_w", tokens(text))
    counted = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims).transform(words)
    model = fitted or IDF(inputCol="_tf", outputCol="_ti").fit(counted)
    unit = Normalizer(inputCol="_ti", outputCol="_u", p=2.0).transform(model.transform(counted))
    return unit.withColumn(out, vector_to_array("_u", "float32")).drop("_w", "_tf", "_ti", "_u")


def identity_rewrite(df: DataFrame) -> DataFrame:
    """Default query rewriter: the query itself."""
    return df.withColumn("resolved_query", resolved_query("query", F.lit("")))


def extractive_answers(df: DataFrame) -> DataFrame:
    """Default answer step: best matching context sentence (query, context array of blocks)."""
    return df.withColumn("response", sentence_overlap_answer(F.col("query"), F.col("context")))


def ngram_verifier(df: DataFrame, n: int = 3) -> DataFrame:
    """Default groundedness step, passed through the same gate as a model's JSON reply."""
    joined = F.array_join("context", "\n")
    share = F.round(ngram_groundedness(F.col("response"), joined, n), 6)
    payload = F.to_json(F.struct(share.alias("groundedness")))
    gated = df.withColumn("_g", groundedness_gate("response", payload))
    return gated.select(*[c for c in df.columns if c != "response"], "_g.*")
