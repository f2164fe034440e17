"""Vector retrieval for batches of queries: a block matrix product.

Corpus vectors and query vectors are packed into blocks of unit rows where they
are read.  Blocks meet by a join - one matrix product per pair of blocks - and a task
keeps the best ``k`` of every query over all its pairs, so nothing but candidates is
shuffled afterwards and no pair table is built.  Query blocks of a checked
total size are broadcast by the join; beyond it the corpus blocks are dealt to a grid
of cells and the query blocks are copied to every cell.  No vector reaches the driver.
A second list over a part of the corpus comes out of the same products.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, StructField, StructType

from foliant import rules as R
from foliant.plans.lineage import discard, materialize

BLOCK_VALUES = 1 << 18  # entries of a block of vectors (2 MB in double precision)
BROADCAST_BYTES = 32 << 20  # query blocks of at most this total size are broadcast
HELD = 1 << 21  # candidates a task holds before it hands them on
DIGITS = 9  # similarities are compared after rounding, so the order does not depend on summation order


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays, computed in double; null for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors of the arrays that have a direction (a zero vector has no neighbours)."""
    mat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.linalg.norm(mat, axis=1)
    live = np.flatnonzero(norm > 0)
    return live, mat[live] / norm[live, None]


def packed_blocks(rows: DataFrame, ident: str, vector: str, scope: str | None, subset: Column | None = None) -> DataFrame:
    """``(scope, ids, inside, mat)``: blocks of vectors of one scope, packed batch by batch; rows without a vector or scope go."""
    usable = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0))
    if scope:
        usable = usable.filter(F.col(scope).isNotNull())
    named = F.col(scope).alias("scope") if scope else F.lit(0).alias("scope")
    usable = usable.select(F.col(ident).alias("id"), F.col(vector).alias("vector"), named,
                           F.coalesce(subset if subset is not None else F.lit(True), F.lit(False)).alias("inside"))
    schema = StructType([StructField("scope", usable.schema["scope"].dataType), StructField("ids", ArrayType(usable.schema["id"].dataType)),
                         StructField("inside", ArrayType(BooleanType())), StructField("mat", BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            live, mat = unit_rows(batch.column("vector"))
            ids, names, inside = (batch.column(c).take(pa.array(live)) for c in ("id", "scope", "inside"))
            codes = names.dictionary_encode()
            of = codes.indices.to_numpy(zero_copy_only=False)
            size = max(1, BLOCK_VALUES // max(1, mat.shape[1]))
            for code in range(len(codes.dictionary)):
                rows_of = np.flatnonzero(of == code)
                for k in range(0, len(rows_of), size):
                    at = rows_of[k: k + size]
                    take, ends = pa.array(at), pa.array([0, len(at)], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [codes.dictionary.slice(code, 1), pa.ListArray.from_arrays(ends, ids.take(take)),
                         pa.ListArray.from_arrays(ends, inside.take(take)), pa.array([np.ascontiguousarray(mat[at]).tobytes()], pa.binary())],
                        ["scope", "ids", "inside", "mat"])

    return usable.mapInArrow(pack, schema)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of few rows while what is written inside holds blocks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def meet(corpus: DataFrame, queries: DataFrame, on: list[str], size: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs of corpus and query blocks with equal ``on``: broadcast queries of a checked size, or a grid.

    In the grid a corpus block moves once, and the query blocks are copied to each
    of as many cells as there are shuffle partitions, so one busy key is spread.
    """
    total = queries.agg(F.sum(size).alias("b")).first()["b"] or 0  # one number
    if total <= broadcast_bytes:
        return corpus.join(F.broadcast(queries), on)
    cells = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = corpus.withColumn("_cell", F.pmod(F.xxhash64("ids"), F.lit(cells)).cast("int"))
    copied = queries.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    return dealt.hint("merge").join(copied, [*on, "_cell"])


class Best:
    """The ``k`` best (similarity, key) of every query a task has seen."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, query, sims: np.ndarray, keys: np.ndarray) -> None:
        if len(sims) > self.k:
            # Everything at or above the k-th value, ties included; exact order below.
            pick = np.flatnonzero(sims >= np.partition(sims, len(sims) - self.k)[len(sims) - self.k])
            sims, keys = sims[pick], keys[pick]
        if query in self.held:
            sims, keys = np.concatenate([self.held[query][0], sims]), np.concatenate([self.held[query][1], keys])
        order = np.lexsort((keys, -sims))[: self.k]
        if len(order):
            self.held[query] = (sims[order], keys[order])


def _score(pairs: DataFrame, lists: list[tuple[int, bool]], q_field: StructField, k_field: StructField) -> DataFrame:
    """``(query_id, key, similarity, list_no)``: the best of every task."""
    schema = StructType([q_field, k_field, StructField("similarity", DoubleType()), StructField("list_no", IntegerType())])
    q_type, k_type = to_arrow_type(q_field.dataType), to_arrow_type(k_field.dataType)

    def drain(best: list[Best]) -> Iterator[pa.RecordBatch]:
        for no, b in enumerate(best):
            for query, (sims, keys) in b.held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([query] * len(sims), q_type), pa.array(keys.tolist(), k_type), pa.array(sims),
                     pa.array(np.full(len(sims), no), pa.int32())], schema.names)
            b.held = {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for k, _ in lists]
        for batch in batches:
            for i in range(batch.num_rows):
                keys = np.asarray(batch.column("ids")[i].as_py())
                inside = np.asarray(batch.column("inside")[i].as_py(), bool)
                queries = batch.column("q_ids")[i].as_py()
                mat = np.frombuffer(batch.column("mat")[i].as_buffer(), np.float64).reshape(len(keys), -1)
                q_mat = np.frombuffer(batch.column("q_mat")[i].as_buffer(), np.float64).reshape(len(queries), -1)
                sims = np.round(mat @ q_mat.T, DIGITS)
                for (_, part), b in zip(lists, best, strict=True):
                    s, own = (sims[inside], keys[inside]) if part else (sims, keys)
                    for j, query in enumerate(queries):
                        b.add(query, s[:, j], own)
            if sum(len(b.held) * b.k for b in best) > HELD:
                yield from drain(best)
        yield from drain(best)

    return pairs.select("ids", "inside", "mat", "q_ids", "q_mat").mapInArrow(score, schema)


def dense_lists(chunks: DataFrame, queries: DataFrame, k: int = R.TOP_K_DENSE, subset: Column | None = None, k_subset: int = R.TOP_K_SCOPED,
                key: str = "chunk_key", scope: str | None = "source_id", vector: str = "embedding",
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, key, similarity, rank, list_no): list 0 over all chunks of the query's scope and, where ``subset``
    is given, list 1 over those it selects - both from one scan of the corpus."""
    spark = chunks.sparkSession
    asked = materialize(packed_blocks(queries, "query_id", vector, scope).select(
        "scope", F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat")), "query-blocks")
    blocks = packed_blocks(chunks, key, vector, scope, subset)
    lists = [(k, False)] + ([(k_subset, True)] if subset is not None else [])
    with batches_of(spark, 4):
        pairs = meet(blocks, asked, ["scope"], F.length("q_mat"), broadcast_bytes)
        hits = materialize(_score(pairs, lists, StructField("query_id", queries.schema["query_id"].dataType),
                                  StructField(key, chunks.schema[key].dataType)), "hits")
    discard(asked)
    order = Window.partitionBy("query_id", "list_no").orderBy(F.col("similarity").desc(), F.col(key))
    most = F.when(F.col("list_no") == 0, k).otherwise(k_subset)
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= max(k, k_subset)) & (F.col("rank") <= most))
    return ranked.select("query_id", key, "similarity", F.col("rank").cast("bigint").alias("rank"), "list_no")


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int = R.TOP_K_DENSE, key: str = "chunk_key",
               scope: str | None = "source_id", vector: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, key, similarity, rank): ``k`` nearest chunks by cosine within the query's source."""
    return dense_lists(chunks, queries, k, key=key, scope=scope, vector=vector, broadcast_bytes=broadcast_bytes).drop("list_no")
