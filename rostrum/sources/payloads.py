"""Recorded API payloads as tables, and attachments as text; the paged listing is in `streaming.listing`.

Everything works on files that a connector has saved verbatim; no query talks to the network.
"""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rostrum.functions import text as tx
from rostrum.functions.text import normalize_text

LARGEST = 60 << 20
MARK_UNREACHABLE = "[ATTACHMENT-UNREACHABLE-OR-OVERSIZED]"
MARK_SCANNED = "[SCANNED-NO-TEXT-LAYER]"

COMMENT = "struct<id: string, attributes: struct<docketId: string, commentOnDocumentId: string, postedDate: string, receiveDate: string, firstName: string, lastName: string, organization: string, title: string, comment: string>>"
DOCUMENT = "struct<id: string, attributes: struct<documentType: string, title: string, postedDate: string, frDocNum: string>>"
DOCKET = "struct<id: string, attributes: struct<title: string, agencyId: string, docketType: string>>"


def _timestamp(iso: Column) -> Column:
    return F.try_to_timestamp(tx.filter_date(iso)).cast("timestamp_ntz")


def dockets(raw: DataFrame) -> DataFrame:
    """dockets from (payload)."""
    d = F.from_json("payload", f"struct<data: {DOCKET}>")["data"]
    return raw.select(d.alias("d")).where("d.id is not null").select(
        F.col("d.id").alias("docket_id"), F.col("d.attributes.title").alias("title"), F.col("d.attributes.agencyId").alias("agency"), F.col("d.attributes.docketType").alias("docket_type")
    )


def documents(raw: DataFrame) -> DataFrame:
    """documents from listing pages (docket_id, payload)."""
    rows = raw.select("docket_id", F.explode(F.from_json("payload", f"struct<data: array<{DOCUMENT}>>")["data"]).alias("d"))
    return rows.select(
        F.col("d.id").alias("document_id"), "docket_id", F.col("d.attributes.documentType").alias("document_type"), F.col("d.attributes.title").alias("title"),
        F.substring("d.attributes.postedDate", 1, 10).try_cast("date").alias("posted_date"), F.col("d.attributes.frDocNum").alias("fr_doc_number"),
    )


def comments(raw: DataFrame, attachments: DataFrame) -> DataFrame:
    """comments from (payload), with the attachment texts (comment_id, attach_text, n_attachments)."""
    rows = raw.select(F.from_json("payload", f"struct<data: {COMMENT}>")["data"].alias("d")).where("d.id is not null").select("d.id", "d.attributes.*")
    joined = rows.withColumnRenamed("id", "comment_id").join(attachments, "comment_id", "left").withColumn("body", tx.normalize(F.col("comment")))
    name = F.concat_ws(" ", F.nullif("firstName", F.lit("")), F.nullif("lastName", F.lit("")))
    full = F.trim(F.concat_ws("\n\n", F.nullif("body", F.lit("")), F.nullif("attach_text", F.lit(""))))
    return joined.select(
        "comment_id", F.col("docketId").alias("docket_id"), F.col("commentOnDocumentId").alias("document_id"), _timestamp(F.col("postedDate")).alias("posted_date"),
        _timestamp(F.col("receiveDate")).alias("received_date"), F.nullif(name, F.lit("")).alias("submitter"), "organization",
        F.when(F.coalesce("organization", F.lit("")) != "", "Organization").otherwise("Individual").alias("submitter_type"), "title", "body", "attach_text", full.alias("full_text"),
        F.coalesce("n_attachments", F.lit(0)).alias("n_attachments"), tx.text_source(F.col("body"), F.col("attach_text")).alias("text_source"), tx.word_count(full).cast("int").alias("word_count"),
    )


def pull(listed: DataFrame, have: DataFrame, limit: int | None = None) -> DataFrame:
    """Comment ids that aren't stored yet; `limit` caps a trial pull."""
    todo = listed.select("comment_id").distinct().join(have.select("comment_id"), "comment_id", "left_anti")
    return todo.orderBy("comment_id").limit(limit) if limit is not None else todo


# attachments

PDF_PAGES = 1200
#: Fixed value: what marks a text that stops at the page limit.
MARK_TRUNCATED = "[TRUNCATED-AT-1200-PAGES]"


def docx_text(data: bytes) -> str:
    """Paragraphs of a word-processing file; empty if it can't be read."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    return "\n".join("".join(t.text or "" for t in p.iter() if name(t) == "t") for p in root.iter() if name(p) == "p").strip()


def pdf_text(data: bytes) -> str:
    """Text of a PDF if a reader is installed, else nothing, as of an unreadable file. A file without a text layer is marked,
    and so is what stops after PDF_PAGES pages."""
    try:
        import pymupdf
    except ImportError:
        return ""
    try:
        with pymupdf.open(stream=data, filetype="pdf") as f:
            pages = [page.get_text() for page in itertools.islice(f, PDF_PAGES)]
            more = [MARK_TRUNCATED] if f.page_count > PDF_PAGES else []
    except Exception:  # whatever the reader raises for a broken file
        return ""
    text = "\n".join([*pages, *more]).strip()
    return text if len(text) >= 40 else MARK_SCANNED


@F.pandas_udf(T.StringType())
def attachment_text(extension: pd.Series, content: pd.Series) -> pd.Series:
    out = []
    for ext, data in zip(extension, content, strict=True):
        ext = (ext or "").lower().lstrip(".")
        if data is None or len(data) > LARGEST:
            out.append(MARK_UNREACHABLE)
        elif ext == "pdf":
            out.append(pdf_text(data))
        elif ext in ("doc", "docx"):
            out.append(docx_text(data))
        elif ext in ("txt", "htm", "html"):
            out.append(normalize_text(bytes(data).decode("utf-8", "replace")))
        else:
            out.append(f"[UNPARSED-FORMAT {ext}]")
    return pd.Series(out, dtype=object)


def harvest(files: DataFrame) -> DataFrame:
    """comment_id, attach_text, n_attachments from (comment_id, position, extension, content)."""
    texts = files.select("comment_id", "position", attachment_text("extension", "content").alias("t"))
    agg = texts.groupBy("comment_id").agg(F.array_sort(F.collect_list(F.struct("position", "t"))).alias("parts"), F.count(F.lit(1)).cast("int").alias("n_attachments"))
    return agg.select("comment_id", F.array_join(F.filter(F.transform("parts", lambda p: p["t"]), lambda x: x != ""), "\n\n").alias("attach_text"), "n_attachments")


def raw_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files as they were saved."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


class PayloadSource(DataSource):
    """`spark.read.format("payloads").option("path", folder)`: saved JSON payloads of a local or mounted folder, one file a partition."""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return "name string, payload string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PayloadReader(self.options)


class _PayloadReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        import os

        return [InputPartition(f) for f in sorted(os.listdir(self.path)) if f.endswith(".json")] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            with open(f"{self.path}/{partition.value}", encoding="utf-8") as f:
                yield partition.value.removesuffix(".json"), f.read()
