"""Schemas of the stored tables and in-flight records, and table loaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SOURCES = "source_id string, domain string, created_at timestamp_ntz"
DOCUMENTS = (
    "doc_id string, source_id string, url string, canonical_url string, title string, page_type string, "
    "content_type string, authority_score double, original_filename string, content_hash string, "
    "content string, fetched_at timestamp_ntz"
)
CHUNKS = (
    "doc_id string, chunk_id int, text string, context string, embedding array<float>, "
    "token_count int, created_at timestamp_ntz"
)
SESSIONS = "session_id string, created_at timestamp_ntz, last_activity_at timestamp_ntz, session_state string"
MESSAGES = (
    "message_id string, session_id string, role string, text string, source_id string, created_at timestamp_ntz"
)
USERS = (
    "user_id string, external_id string, email string, api_key string, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, last_sign_in_at timestamp_ntz"
)
GRANTS = "user_id string, source_id string, created_at timestamp_ntz"
FACTS = (
    "source_id string, canonical_url string, program_name string, fact_key string, fact_value string, "
    "evidence_text string, confidence double, fetched_at timestamp_ntz"
)
LINKS = "src_url string, dst_url string"

CAPTURES = "url string, success boolean, markdown string, html string, cleaned_html string, raw_html string, title string"
EVAL_ITEM = (
    "id string, category string, difficulty string, question string, expected_answer_summary string, "
    "notes string, expected_facts array<string>, ground_truth_urls array<string>, "
    "must_not_contain array<string>, expects_clarification boolean, conversation_id string, turn_number int"
)
EVAL_RESULT = EVAL_ITEM + (
    ", session_id string, answer string, context_chunks array<string>, error string, elapsed_ms double"
)
PROBE_RESULT = (
    "id bigint, category string, q string, expects_decline boolean, answer string, groundedness double, "
    "unsupported_claims array<string>, duration_s double, decline boolean, ok boolean, error string"
)
SPANS = "doc_id string, page int, block int, block_type int, line int, span int, text string, size double, flags int"
SITEMAPS = "sitemap_url string, xml string"


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a folder (columns and filters are pushed into the scan)."""
    return spark.read.parquet(f"{root}/{name}.parquet")
