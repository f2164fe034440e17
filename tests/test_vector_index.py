"""The stored vector index: recall and what it reads, against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import dense, vector_index
from foliant.plans.lineage import new_dir

SF = "/root/testdata/sf0.1"


def found(df):
    return {(r.query_id, r.chunk_key) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered(spark):
    g = np.random.default_rng(3)
    centers = g.normal(size=(30, 16))
    rows = [(i, [float(x) for x in centers[i % 30] + g.normal(scale=0.2, size=16)]) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(700)]  # a third of all vectors is one vector
    rows += [(5000, None), (5001, []), (5002, [0.0] * 16)]
    chunks = spark.createDataFrame(rows, "chunk_key long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, [float(x) for x in centers[i] + g.normal(scale=0.1, size=16)]) for i in range(30)],
                              "query_id int, embedding array<float>")
    return chunks, q


def test_recall_and_reads(spark, clustered):
    chunks, q = clustered
    index = vector_index.build(chunks, new_dir(spark, "vectors"), cells=48)
    stored = vector_index.stored(spark, index)
    assert stored.count() == 2200 and stored.select("key").distinct().count() == 2200
    assert 0 < index.probes < 24
    exact = found(dense.dense_topk(chunks, q, 40, scope=None))
    got = found(vector_index.search(spark, index, q, 40))
    assert len(got) == len(exact) and len(got & exact) >= 0.9 * len(exact)
    # Codes are read from the cells looked into, vectors only for what is compared exactly.
    one = q.filter("query_id = 7")
    near = vector_index.candidates(spark, index, one, 160, "embedding", index.probes, dense.BROADCAST_BYTES)
    assert 0 < near.count() <= 160 < 0.5 * 2200
    cells = {r.cell for r in stored.join(near.select("key"), "key").select("cell").distinct().collect()}
    assert len(cells) <= index.probes


def test_recall_on_the_sample_vectors(spark):
    """The sample vectors have hardly any clusters, so many cells are looked into; vectors are read for few rows."""
    chunks = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_key"), "embedding")
    q = chunks.filter("chunk_key % 100 = 0").withColumnRenamed("chunk_key", "query_id")
    index = vector_index.build(chunks, new_dir(spark, "vectors"))
    exact = found(dense.dense_topk(chunks, q, 40, scope=None))
    got = found(vector_index.search(spark, index, q, 40))
    assert len(got & exact) >= 0.9 * len(exact)
    per_query = vector_index.candidates(spark, index, q, 320, "embedding", index.probes, dense.BROADCAST_BYTES).groupBy("query_id").count()
    assert per_query.agg(F.max("count")).first()[0] <= 320 < 0.5 * chunks.count()


def test_grid_and_reload(spark, clustered):
    chunks, q = clustered
    path = new_dir(spark, "vectors")
    index = vector_index.build(chunks, path, cells=20, groups=5, codes=32)
    assert index.groups == 4  # the largest number of groups that divides 16 dimensions
    again = vector_index.load(spark, path)
    assert again.probes == index.probes and np.array_equal(again.centroids, index.centroids) and np.array_equal(again.codebook, index.codebook)
    wide = found(vector_index.search(spark, index, q, 10))
    assert found(vector_index.search(spark, again, q, 10, broadcast_bytes=0)) == wide
    every = vector_index.search(spark, index, q, 10, probes=20, rerank=3000)
    assert found(every) == found(dense.dense_topk(chunks, q, 10, scope=None))
    none = q.limit(0)
    assert vector_index.search(spark, index, none).collect() == []
    with pytest.raises(ValueError, match="no vector"):
        vector_index.build(chunks.filter("chunk_key >= 5000"), path)


def test_small_and_equal_vectors(spark):
    chunks = spark.createDataFrame([(k, [1.0, 0.0]) for k in ("b", "a", "c")], "chunk_key string, embedding array<double>")
    index = vector_index.build(chunks, new_dir(spark, "vectors"))
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id int, embedding array<double>")
    rows = vector_index.search(spark, index, q, 2).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_key, r.similarity, r["rank"]) for r in rows] == [(1, "a", 1.0, 1), (1, "b", 1.0, 2)]
