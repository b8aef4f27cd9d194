"""The declared tables, and widening-only alignment of older data to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(text: str) -> T.StructType:
    return T.StructType.fromDDL(text) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(text)


_DDL = {
    "dockets": "docket_id string, title string, agency string, docket_type string, fetched_at timestamp_ntz",
    "documents": "document_id string, docket_id string, document_type string, title string, posted_date date, fr_doc_number string, comment_count int",
    "comments": "comment_id string, docket_id string, document_id string, posted_date timestamp_ntz, received_date timestamp_ntz, submitter string, "
    "organization string, submitter_type string, title string, body string, attach_text string, full_text string, n_attachments int, text_source string, word_count int",
    "dedup": "docket_id string, comment_id string, exact_hash string, campaign_id string, is_exemplar boolean, template_ratio double, insert_text string",
    "clusters": "docket_id string, cluster_id int, comment_id string, is_medoid boolean",
    "analysis": "comment_id string, stance string, argument_types array<string>, provisions array<string>, requested array<string>, novel_evidence boolean, "
    "evidence_note string, significance int, summary string, model string, tokens_in int, tokens_out int",
    "responses": "response_id string, document_id string, seq int, comment_para string, response_para string, fr_page string",
    "linkage": "docket_id string, comment_id string, response_id string, score double, method string, verdict string, rationale string",
    "textdiff": "docket_id string, section string, sort_key double, change_kind string, similarity double, magnitude double, words_proposed int, "
    "words_final int, proposed_text string, final_text string",
    "api_calls": "ts timestamp_ntz, service string, endpoint string, status int, remaining int, limit_total int, model string, tokens_in int, tokens_out int",
    "runlog": "ts timestamp_ntz, stage string, detail string",
}

KEYS = {"dockets": ["docket_id"], "documents": ["document_id"], "comments": ["comment_id"], "dedup": ["docket_id", "comment_id"], "analysis": ["comment_id"], "responses": ["response_id"]}
#: Tables replaced docket by docket, and append-only facts.
SCOPED = {"dedup": "docket_id", "clusters": "docket_id", "linkage": "docket_id", "textdiff": "docket_id", "responses": "document_id"}
FACTS = ("api_calls", "runlog")


def table_schema(name: str) -> T.StructType:
    return _table(_DDL[name])


def names() -> list[str]:
    return list(_DDL)


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` with every column of `schema`: missing ones as typed nulls, present ones as they are, others kept."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    first = [f.name for f in schema]
    return df.withColumns(missing).select(*first, *(c for c in df.columns if c not in first)) if missing else df.select(*first, *(c for c in df.columns if c not in first))


def units(comments: DataFrame, dedup: DataFrame) -> DataFrame:
    """The analysis units: comments that stand alone or stand for their campaign."""
    return comments.join(dedup, "comment_id").where(F.col("campaign_id").isNull() | F.col("is_exemplar"))
