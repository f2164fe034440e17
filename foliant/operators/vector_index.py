"""Stored vector index: an inverted file of cells with product-quantised residuals, and exact re-ranking.

Build: centroids of the cells, then a codebook of the residuals for each group of
dimensions, are fitted by Lloyd rounds over a bounded sample - every round is one Spark
job whose tasks add up their points per centroid.  All vectors are then put into their
nearest cell and stored, partitioned by cell, as key, one code byte per group, and the
vector itself.

Search: a query goes to its nearest cells; only those partitions are read, and of
them only the codes.  Blocks of codes meet blocks of queries per cell and are scored by
table look-up; the best ``rerank`` of each query are compared exactly, from the vectors of
those keys alone.  How many cells a query needs for a wished recall is measured on
the sample when the index is built (``probes``).

Vectors have unit length inside the index.  Null, empty and zero vectors are not in it;
all vectors must have one length.  Ties: nearer means the smaller distance after rounding,
then the smaller cell; equal similarities go by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from foliant import rules as R
from foliant.operators.dense import BROADCAST_BYTES, DIGITS, Best, batches_of, cosine, meet, unit_rows
from foliant.plans.lineage import discard, materialize

SAMPLE, MAX_CELLS, GROUPS, CODES, ROUNDS = 50_000, 4096, 8, 256, 4
RECALL, TRIED = 0.95, 200  # wished recall, and the queries of the sample it is measured with
BLOCK_ROWS = 1 << 16
RUN = 64  # centers whose sums travel in one row
RERANK = 8  # candidates by codes for each neighbour asked for


@dataclass(frozen=True)
class VectorIndex:
    path: str
    key: str
    centroids: np.ndarray  # cells x dimensions
    codebook: np.ndarray  # groups x codes x (dimensions / groups)
    probes: int

    @property
    def groups(self) -> int:
        return len(self.codebook)


def nearest(x: np.ndarray, centers: np.ndarray, k: int = 1) -> np.ndarray:
    """The ``k`` nearest centers of each row, nearest first; equal distances by number."""
    far = np.round((centers * centers).sum(axis=1)[None, :] - 2 * x @ centers.T, DIGITS)
    return far.argmin(axis=1)[:, None] if k == 1 else np.argsort(far, axis=1, kind="stable")[:, :k]


def split_groups(x: np.ndarray, groups: int) -> np.ndarray:
    """rows x dimensions as groups x rows x (dimensions of a group)."""
    return np.moveaxis(x.reshape(len(x), groups, -1), 1, 0)


def _vectors(column: pa.Array) -> np.ndarray:
    return unit_rows(column)[1]


def lloyd(sample: DataFrame, start: np.ndarray, rounds: int, cells: np.ndarray | None = None) -> np.ndarray:
    """Centers (groups x k x width) after some rounds over ``vector`` rows; with ``cells``, of their residuals.

    A center without points stays where it is.
    """
    centers, groups = start, len(start)

    for _ in range(rounds):
        now = centers

        def add_up(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(now.shape), np.zeros(now.shape[:2], np.int64)
            for batch in batches:
                x = _vectors(batch.column("vector"))
                if not len(x):
                    continue
                if cells is not None:
                    x = x - cells[nearest(x, cells)[:, 0]]
                for g, part in enumerate(split_groups(x, groups)):
                    of = nearest(part, now[g])[:, 0]
                    np.add.at(sums[g], of, part)
                    counts[g] += np.bincount(of, minlength=now.shape[1])
            found = [(g, c) for g in range(groups) for c in range(0, now.shape[1], RUN) if counts[g, c: c + RUN].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()),
                 pa.array([counts[g, c: c + RUN].tolist() for g, c in found], pa.list_(pa.int64())),
                 pa.array([sums[g, c: c + RUN].reshape(-1).tolist() for g, c in found], pa.list_(pa.float64()))], ["g", "c", "n", "s"])

        def merge(table: pa.Table) -> pa.Table:
            total = {k: np.array(table[k].to_pylist()).sum(axis=0).tolist() for k in ("n", "s")}
            return pa.table({"g": table["g"][:1], "c": table["c"][:1], "n": [total["n"]], "s": [total["s"]]}, schema=table.schema)

        kinds = "g int, c int, n array<long>, s array<double>"
        parts = sample.select("vector").mapInArrow(add_up, kinds)
        rows = parts.groupBy("g", "c").applyInArrow(merge, kinds).collect()  # one row per run of centers
        centers = now.copy()
        for r in rows:
            n, s = np.array(r.n), np.array(r.s).reshape(len(r.n), -1)
            at = np.flatnonzero(n)
            centers[r.g, r.c + at] = s[at] / n[at, None]
    return centers


def calibrated(x: np.ndarray, cells: np.ndarray, k: int, recall: float) -> int:
    """The fewest nearest cells that hold ``recall`` of the true neighbours, measured with rows of the sample as queries."""
    asked = x[: TRIED]
    place = nearest(x, cells)[:, 0]
    k = min(k, len(x) - 1)
    if k < 1:
        return len(cells)
    true = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1: k + 1]  # without itself
    order = nearest(asked, cells, len(cells)) if len(cells) > 1 else np.zeros((len(asked), 1), np.int64)
    rank = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(rank, place[true], axis=1).reshape(-1)) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def build(chunks: DataFrame, path: str, key: str = "chunk_key", vector: str = "embedding", cells: int | None = None, groups: int = GROUPS,
          codes: int = CODES, sample_rows: int = SAMPLE, rounds: int = ROUNDS, recall: float = RECALL, k: int = R.TOP_K_DENSE) -> VectorIndex:
    """Fit and write the index of all ``chunks``; ``cells`` defaults to the root of their number (at most ``MAX_CELLS``).

    The sample is at most ``sample_rows`` rows, those with the smallest digest of
    their key, so it does not depend on the partitioning.
    """
    spark = chunks.sparkSession
    usable = chunks.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.exists(vector, lambda v: v != 0))
    total = usable.count()
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    share = min(1.0, 2 * sample_rows / max(1, total))
    few = usable.filter(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") <= F.lit(int(share * 0xFFFFFFFF)))
    few = few.select(F.col(vector).alias("vector"), digest.alias("d")).orderBy("d").limit(sample_rows)
    sample = materialize(few.select("vector"), "sample")
    n_cells = min(cells or max(1, min(MAX_CELLS, round(total ** 0.5))), max(1, total))
    # The first rows in order of the digest; bounded by the number of centers.
    head = [r.vector for r in few.limit(max(n_cells, codes, min(sample_rows, 20_000))).collect()]
    if not head:
        raise ValueError("no vector to index")
    x = np.array(head, np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    groups = next(g for g in range(min(groups, x.shape[1]), 0, -1) if x.shape[1] % g == 0)
    centroids = lloyd(sample, x[None, :n_cells], rounds)[0]
    rest = split_groups(x - centroids[nearest(x, centroids)[:, 0]], groups)
    codebook = lloyd(sample, rest[:, : min(codes, len(x))].copy(), rounds, centroids)
    discard(sample)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            live, u = unit_rows(batch.column("vector"))
            take = pa.array(live)
            cell = nearest(u, centroids)[:, 0] if len(u) else np.zeros(0, np.int64)
            parts = split_groups(u - centroids[cell], groups) if len(u) else []
            code = np.stack([nearest(p, codebook[g])[:, 0] for g, p in enumerate(parts)], axis=1).astype(np.uint8) if len(u) else np.zeros((0, groups), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(take), pa.array([c.tobytes() for c in code], pa.binary()), batch.column("vector").take(take),
                 pa.array(cell, pa.int32())], ["key", "code", "vector", "cell"])

    rows = usable.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    schema = StructType([StructField("key", chunks.schema[key].dataType), StructField("code", BinaryType()),
                         StructField("vector", chunks.schema[vector].dataType), StructField("cell", IntegerType())])
    # Rebalancing gives each cell its own files and splits a cell that holds much of the corpus.
    rows.mapInArrow(encode, schema).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    index = VectorIndex(path, key, centroids, codebook, calibrated(x, centroids, k, recall))
    _write_model(spark, index)
    return index


def _write_model(spark: SparkSession, index: VectorIndex) -> None:
    rows = [("cell", 0, i, c.tolist()) for i, c in enumerate(index.centroids)]
    rows += [("code", g, i, c.tolist()) for g, book in enumerate(index.codebook) for i, c in enumerate(book)]
    rows.append(("probes", 0, index.probes, []))
    model = spark.createDataFrame(rows, "kind string, part int, number int, center array<double>")
    model.coalesce(1).write.mode("overwrite").parquet(f"{index.path}/model")


def load(spark: SparkSession, path: str, key: str = "chunk_key") -> VectorIndex:
    """The index at ``path``; what is read here is bounded by the numbers of cells and codes."""
    rows = sorted(spark.read.parquet(f"{path}/model").collect(), key=lambda r: (r.part, r.number))
    groups = 1 + max(r.part for r in rows)
    book = np.array([[r.center for r in rows if r.kind == "code" and r.part == g] for g in range(groups)])
    return VectorIndex(path, key, np.array([r.center for r in rows if r.kind == "cell"]), book, next(r.number for r in rows if r.kind == "probes"))


def stored(spark: SparkSession, index: VectorIndex) -> DataFrame:
    """``(key, code, vector, cell)``."""
    return spark.read.parquet(f"{index.path}/cells")


def _asked(queries: DataFrame, index: VectorIndex, vector: str, probes: int) -> DataFrame:
    """``(cell, q_ids, q_mat)``: blocks of the unit vectors of the queries that look into a cell."""
    schema = StructType([StructField("cell", IntegerType()), StructField("q_ids", ArrayType(queries.schema["query_id"].dataType)),
                         StructField("q_mat", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                live, u = unit_rows(some.column(1))
                if not len(live):
                    continue
                near = nearest(u, index.centroids, probes)
                for cell in np.unique(near).tolist():
                    at = np.flatnonzero((near == cell).any(axis=1))
                    ids = some.column(0).take(pa.array(live[at]))
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids),
                                                      pa.array([u[at].tobytes()], pa.binary())], schema.names)

    return queries.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select("query_id", vector).mapInArrow(run, schema)


def _code_blocks(rows: DataFrame) -> DataFrame:
    schema = StructType([StructField("cell", IntegerType()), StructField("ids", ArrayType(rows.schema["key"].dataType)), StructField("codes", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            for c in np.unique(cell).tolist():
                of = np.flatnonzero(cell == c)
                for k in range(0, len(of), BLOCK_ROWS):
                    take = pa.array(of[k: k + BLOCK_ROWS])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(take)], pa.int32()), batch.column("key").take(take)),
                         pa.array([b"".join(batch.column("code").take(take).to_pylist())], pa.binary())], schema.names)

    return rows.select("cell", "key", "code").mapInArrow(run, schema)


def candidates(spark: SparkSession, index: VectorIndex, queries: DataFrame, rerank: int, vector: str, probes: int,
               broadcast_bytes: int) -> DataFrame:
    """``(query_id, key)``: the best of each query by the codes of its cells."""
    asked = materialize(_asked(queries, index, vector, probes), "asked")
    cells = [r.cell for r in asked.select("cell").distinct().collect()]  # at most the cells of the index
    rows = stored(spark, index).filter(F.col("cell").isin(cells))
    schema = StructType([queries.schema["query_id"], StructField("key", rows.schema["key"].dataType), StructField("near", DoubleType())])
    q_type, k_type = to_arrow_type(schema["query_id"].dataType), to_arrow_type(schema["key"].dataType)
    width = index.codebook.shape[2]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(rerank)
        for batch in batches:
            for i in range(batch.num_rows):
                keys = np.asarray(batch.column("ids")[i].as_py())
                code = np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint8).reshape(len(keys), index.groups)
                queries_of = batch.column("q_ids")[i].as_py()
                q = np.frombuffer(batch.column("q_mat")[i].as_buffer(), np.float64).reshape(len(queries_of), -1)
                base = q @ index.centroids[batch.column("cell")[i].as_py()]
                table = np.einsum("qgw,gcw->qgc", q.reshape(len(q), index.groups, width), index.codebook)
                for j, query in enumerate(queries_of):
                    near = base[j] + table[j][np.arange(index.groups), code].sum(axis=1)
                    best.add(query, np.round(near, DIGITS), keys)
        for query, (near, keys) in best.held.items():
            yield pa.RecordBatch.from_arrays([pa.array([query] * len(near), q_type), pa.array(keys.tolist(), k_type), pa.array(near)], schema.names)

    with batches_of(spark, 4):
        pairs = meet(_code_blocks(rows), asked, ["cell"], F.length("q_mat"), broadcast_bytes)
        found = materialize(pairs.select("cell", "ids", "codes", "q_ids", "q_mat").mapInArrow(score, schema), "candidates")
    discard(asked)
    order = Window.partitionBy("query_id").orderBy(F.col("near").desc(), "key")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= rerank).select("query_id", "key")


def search(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int = R.TOP_K_DENSE, vector: str = "embedding",
           probes: int | None = None, rerank: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, key, similarity, rank): the nearest stored vectors of the cells each query looks into."""
    probes = min(probes or index.probes, len(index.centroids))
    near = materialize(candidates(spark, index, queries, rerank or RERANK * k, vector, probes, broadcast_bytes), "near")
    rows = stored(spark, index).select("key", F.col("vector").alias("_v")).join(near.select("key").distinct(), "key", "left_semi")
    pairs = near.join(rows, "key").join(queries.select("query_id", F.col(vector).alias("_q")), "query_id")
    exact = pairs.select("query_id", "key", F.round(cosine(F.col("_v"), F.col("_q")), DIGITS).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "key")
    return exact.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k).select(
        "query_id", F.col("key").alias(index.key), "similarity", "rank")
