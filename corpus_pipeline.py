"""The corpus job: five operators in a row over ``documents``.

Every stage takes all rows its predecessor kept and, but for the last, returns
rows of the columns it got.  Documents are told apart by doc_id and text: different
texts without a doc_id, or sharing one, are different documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm import catalog, contamination, lang_id, mixing, near_dedup, token_files
from foliant.plans.lineage import discard, materialize


def _with_key(docs: DataFrame) -> DataFrame:
    """The text, all columns as one, and the key of each row: its doc_id without nulls and a hash of its text."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(near_dedup.NO_ID)).alias("_id"), F.xxhash64("text").alias("_tag")
    return docs.select("text", F.struct(*docs.columns).alias("_row"), *key)


def _whole_row(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all columns as one, so that results can't clash with them."""
    return docs.select(*names, F.struct(*docs.columns).alias("_row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough confidence; texts without a letter go."""
    model = lang_id.fit(docs.filter(~catalog.held_out()).select("doc_id", "text", "lang"))
    judged = lang_id.predict(_whole_row(docs, "text"), model, keep=("_row",))
    return judged.filter("accepted").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that of the smallest doc_id, and of the smallest hash of the text where several have it."""
    classes = near_dedup.keyed_classes(docs)
    stay = classes.filter("doc_id = class_id AND tag = class_tag").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"))
    kept = _with_key(docs).join(stay, ["_id", "_tag"], "left_semi")
    first = F.row_number().over(Window.partitionBy("_id", "_tag").orderBy("text"))
    return kept.withColumn("_k", first).filter("_k = 1").select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows = _with_key(docs)
    named = rows.select(F.struct("_id", "_tag").alias("doc_id"), "text")
    found = contamination.contaminated(named, catalog.table(spark, sf_dir, "benchmark"))
    return rows.join(found.select("doc_id.*").distinct(), ["_id", "_tag"], "left_anti").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the tokens of sources, languages and topics meet their targets."""
    drawn = mixing.mix(_whole_row(docs, "doc_id", "text", "source", "lang"), catalog.MIX_TARGETS, columns=["_row"])
    return drawn.filter("kept").select("_row.*")


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and per document its place in them."""
    return token_files.read_tokens(spark, token_files.write_tokens(docs, catalog.byte_bpe()))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token files", write_token_files),
]

#: SQL can't express the trained model, the hashes and the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
