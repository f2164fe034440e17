"""Writers: document store with keyed merge, reports, exports, appended results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import urls
from foliant.operators.ingest import upsert_documents
from foliant.plans.lineage import new_dir


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def write_store(df: DataFrame, path: str, key: str = "canonical_url", buckets: int = 64) -> None:
    """Create a store partitioned by a hash bucket of the key (even, whatever the sources' sizes).

    The empty bucket -1 keeps the schema readable even when no row exists yet.
    """
    rows = _bucketed(df, key, buckets)
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/bucket=-1")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def merge_into_store(spark: SparkSession, path: str, incoming: DataFrame, key: str = "canonical_url",
                     buckets: int = 64) -> None:
    """Upsert ``incoming`` into a bucketed store, rewriting only the buckets it touches.

    The merged buckets are first written to the shared working folder and then
    replace the old ones (dynamic partition overwrite), so no job reads and
    overwrites the same files and a lost executor never leaves a half-read store.
    """
    stage = new_dir(spark, "merge")
    fresh = _bucketed(incoming, key, buckets)
    fresh.write.parquet(f"{stage}/incoming")
    fresh = spark.read.schema(fresh.schema).parquet(f"{stage}/incoming")
    touched = fresh.select("bucket").distinct()
    # The bucket join prunes the store's partitions at run time.
    old = spark.read.parquet(path).join(touched, "bucket", "left_semi")
    merged = upsert_documents(old.drop("bucket"), fresh.drop("bucket").select(*old.drop("bucket").columns), key)
    merged = _bucketed(merged, key, buckets)
    merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{stage}/merged")
    spark.read.schema(merged.schema).parquet(f"{stage}/merged").repartition("bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_report(lists: DataFrame, counters: DataFrame, path: str) -> None:
    """Crawl report: text lines per reason list (tab-separated), counters as JSON."""
    lists.select("list", F.col("entry").alias("value")).write.mode("overwrite").partitionBy("list").text(f"{path}/lists")
    counters.write.mode("overwrite").json(f"{path}/summary")


def export_markdown(pages: DataFrame, path: str, buckets: int = 256) -> None:
    """One row per page with its file name, partitioned into even buckets."""
    named = pages.select(urls.export_name("url", "title").alias("file_name"), "url", "title", "text")
    _bucketed(named, "file_name", buckets).write.mode("overwrite").partitionBy("bucket").parquet(path)


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def write_scored(items: DataFrame, aggregates: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(f"{path}/items")
    aggregates.write.mode("overwrite").json(f"{path}/aggregates")


def write_probe_report(summary: DataFrame, failures: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(f"{path}/summary")
    failures.write.mode("overwrite").json(f"{path}/failures")
