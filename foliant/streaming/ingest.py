"""Streaming forms of the ingest, link and counter jobs.

Late data: rows carry ``captured_at``; state is kept for the watermark delay
(default one hour).  The transformations are the batch ones, unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from foliant.functions import html as H
from foliant.functions import urls
from foliant.functions.text import strip
from foliant.operators import metrics
from foliant.operators.ingest import dedup_decisions
from foliant.plans import corpus, lineage
from foliant.rules import PageRules
from foliant.sources import sinks
from foliant.sources.captures import scan_pages

WATERMARK = "1 hour"


def read_capture_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest_stream(pages: DataFrame, store: str, checkpoint: str, rules: PageRules, allowed_host: Column | str,
                  buckets: int = 64) -> StreamingQuery:
    """Merge every micro-batch of captured pages into the document store.

    Within a batch, duplicates follow the batch rule; against the store, pages
    with an unchanged hash are skipped and changed pages replace the old row.
    The merge is keyed, so a replayed batch gives the same store.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        with lineage.staged(spark):
            stored = sinks.read_store(spark, store)
            docs = corpus.prepare_documents(scan_pages(batch), rules, allowed_host)
            keys = stored.select("source_id", "canonical_url", "content_hash")
            fresh = corpus.surviving(docs, dedup_decisions(docs, keys))
            sinks.merge_into_store(spark, store, fresh, buckets=buckets)

    return (
        pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def new_links(pages: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Stream of link targets, each once within the watermark (pages need captured_at)."""
    found = pages.withWatermark("captured_at", watermark).select(
        "captured_at", F.col("url").alias("src_url"), F.explode(H.hrefs("html")).alias("href")
    ).filter(strip(F.col("href")) != "")
    return found.select(
        "captured_at", urls.resolve_link("src_url", "href").alias("url")
    ).dropDuplicatesWithinWatermark(["url"])


def running_counters(results: DataFrame, job: str = "job_id") -> DataFrame:
    """Streaming counters per job (update or complete mode)."""
    return metrics.crawl_counters(results, job)


def write_counters(counters: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the full counter table of every trigger with the batch id as sequence number.

    One folder per sequence number, so readers pick the newest and a replayed
    batch rewrites its own folder only.
    """

    def save(batch: DataFrame, seq: int) -> None:
        batch.withColumn("update_seq", F.lit(seq).cast("bigint")).write.mode("overwrite").parquet(f"{path}/seq={seq}")

    return (
        counters.writeStream.outputMode("complete").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Newest counter table written by ``write_counters`` (partition pruning on seq)."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("seq") == rows.agg(F.max("seq").alias("m")).scalar()).drop("seq")
