"""Ingest and sessions on keyed state: a micro-batch reads the state of its own keys, never the store.

``ingest_decisions`` holds two states.  Per (source, content hash): the page that owns
it, so copies are recognised wherever they arrive.  Per canonical URL: whether it was seen
and how its last version hashes, so a new version is an update.  ``ingest`` writes decisions,
documents, chunks and facts of every micro-batch; a repeated batch rewrites its own folder.

``closed_sessions`` holds a session's running periods as session windows; a period ends when the
watermark shows that the session has been idle, and its state is removed.

Within a micro-batch rows count in order (``order`` column, then id).  A state may have a time to
live; a hash or URL that expired counts as new.  A hash stays owned until then, also when its owner
has moved on to other content.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliant.functions import html as H
from foliant.functions import urls
from foliant.functions.text import strip
from foliant.operators import classify, facts
from foliant.plans import corpus
from foliant.rules import PageRules
from foliant.sources.captures import scan_pages
from foliant.streaming.ingest import WATERMARK

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "doc_id long, source_id string, content_hash string, canonical_url string, payload string, decision string, same_as_url string"


def keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; set where the session has not chosen it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class HashOwner(StatefulProcessor):
    """Per (source, hash): the first page owns it; later ones are copies of the same or of another URL."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "url string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        owner = self.owner.get()[0] if self.owner.exists() else None
        narrow, first = [], None
        for part in rows:  # of the copies of one micro-batch only the first keeps its text
            i = part["doc_id"].idxmin()
            if owner is None and (first is None or part.at[i, "doc_id"] < first[0]):
                first = (part.at[i, "doc_id"], part.at[i, "payload"])
            narrow.append(part.drop(columns="payload"))
        held = pd.concat(narrow).sort_values("doc_id", kind="stable").reset_index(drop=True)
        if owner is None:
            owner = held["canonical_url"].iloc[0]
            self.owner.update((owner,))
        own = held["canonical_url"] == owner
        held["decision"] = own.map({True: "duplicate_content", False: "duplicate_content_other_url"})
        held["same_as_url"] = [None if same else owner for same in own]
        held["payload"] = pd.Series([None] * len(held), dtype=object)
        if first is not None:
            held.loc[0, ["decision", "payload"]] = ["new", first[1]]
        yield held[[c.split()[0] for c in ROWS.split(", ")]]

    def close(self) -> None:
        pass


class UrlVersion(StatefulProcessor):
    """Per canonical URL: new content is saved the first time the URL is seen, an update afterwards."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "content_hash string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values("doc_id", kind="stable")
        last = self.seen.get()[0] if self.seen.exists() else None
        out = []
        for decision, content in zip(held["decision"], held["content_hash"], strict=True):
            if decision == "new":
                decision = "saved" if last is None else "updated"
            out.append(decision)
            last = content if decision in ("saved", "updated") or last is None else last
        self.seen.update((last,))
        held["decision"] = out
        yield held

    def close(self) -> None:
        pass


def ingest_decisions(documents: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Stream of documents (doc_id, source_id, content_hash, canonical_url, payload) with decision and same_as_url."""
    mode = "None" if ttl_ms is None else "ProcessingTime"
    rows = documents.select("doc_id", "source_id", "content_hash", "canonical_url", "payload")
    owned = rows.groupBy("source_id", "content_hash").transformWithStateInPandas(HashOwner(ttl_ms), ROWS, "append", mode)
    return owned.groupBy("canonical_url").transformWithStateInPandas(UrlVersion(ttl_ms), ROWS, "append", mode)


DOCUMENT = ("url", "title", "page_type", "authority_score", "content", "fetched_at")


def ingest(pages: DataFrame, path: str, checkpoint: str, rules: PageRules, allowed_host: Column | str,
           ttl_ms: int | None = None) -> StreamingQuery:
    """Captured pages to decisions, documents, chunks and facts under ``path``, one folder per micro-batch."""
    keyed_state(pages.sparkSession)
    docs = corpus.documents_from_outcomes(classify.page_outcomes(scan_pages(pages), rules, allowed_host))
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "payload": F.to_json(F.struct(*DOCUMENT))})
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*DOCUMENT).schema)

    def save(batch: DataFrame, n: int) -> None:
        def write(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")

        write(batch, "rows")
        rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/rows/batch={n}")
        write(rows.select("doc_id", "source_id", "canonical_url", "content_hash", "decision", "same_as_url"), "decisions")
        live = rows.filter(F.col("decision").isin("saved", "updated"))
        last = live.groupBy("canonical_url").agg(F.max("doc_id").alias("doc_id"))  # the last version within the batch
        live = live.join(last.select("doc_id"), "doc_id", "left_semi")
        fresh = live.select("doc_id", "source_id", "canonical_url", "content_hash", F.from_json("payload", kinds).alias("p"))
        fresh = fresh.select("doc_id", "source_id", "canonical_url", "content_hash", "p.*")
        write(fresh, "documents")
        fresh = batch.sparkSession.read.schema(fresh.schema).parquet(f"{path}/documents/batch={n}")
        write(corpus.chunk_rows(fresh), "chunks")
        write(facts.program_fact_rows(fresh), "facts")

    return ingest_decisions(docs, ttl_ms).writeStream.outputMode("append").foreachBatch(save).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_documents(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every URL over all micro-batches."""
    docs = spark.read.parquet(f"{path}/documents")
    newest = docs.groupBy("canonical_url").agg(F.max(F.struct("batch", "doc_id")).alias("m")).select("canonical_url", "m.*")
    return docs.join(newest, ["canonical_url", "batch", "doc_id"], "left_semi").drop("batch")


def current_children(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Chunks or facts of the current documents: those of replaced versions are gone with them."""
    return spark.read.parquet(f"{path}/{name}").drop("batch").join(current_documents(spark, path).select("doc_id"), "doc_id", "left_semi")


class SeenLink(StatefulProcessor):
    """Per target URL: the first page and position it was found at, passed on once."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "page_id long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            i = part[["page_id", "position"]].apply(tuple, axis=1).idxmin()
            found = (int(part.at[i, "page_id"]), int(part.at[i, "position"]))
            best = found if best is None else min(best, found)
        if not self.first.exists():
            self.first.update((best[0],))
            yield pd.DataFrame({"dst_url": [key[0]], "first_page_id": [best[0]], "first_position": [best[1]]})

    def close(self) -> None:
        pass


def first_links(pages: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Stream of link targets, each once, with the page and position it was first found at.

    A micro-batch's links are few bytes each; the state holds one number per URL.
    """
    keyed_state(pages.sparkSession)
    found = pages.select("page_id", "url", F.posexplode(H.hrefs("html")).alias("position", "href")).filter(strip(F.col("href")) != "")
    found = found.select("page_id", "position", urls.resolve_link("url", "href").alias("dst_url"))
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return found.groupBy("dst_url").transformWithStateInPandas(
        SeenLink(ttl_ms), "dst_url string, first_page_id long, first_position long", "append", mode)


def closed_sessions(messages: DataFrame, idle_ms: int = 30 * 60_000, watermark: str = WATERMARK, at: str = "created_at") -> DataFrame:
    """Stream of ended periods (session_id, started_at, ended_at, turns); idle sessions leave the state.

    A session window per period: a message up to ``idle_ms`` after the last one belongs to it.  The state is read and
    merged once per partition in key order, without a call per session.
    """
    keyed_state(messages.sparkSession)
    period = F.session_window(at, f"{idle_ms} milliseconds")  # windows that touch are one
    ended = messages.withWatermark(at, watermark).groupBy("session_id", period).agg(
        F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count(F.lit(1)).alias("turns"))
    return ended.select("session_id", "started_at", "ended_at", "turns")
