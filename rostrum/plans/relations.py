"""The engine's relations over the driver's tables, as DataFrames and as the same DuckDB common table expressions.

comments stand on `documents`, analysis on `labels`, responses on `benchmark`, text changes on `part`, API calls on
`events`; columns that the tables lack are derived from keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators.campaigns import hashes


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, d: str) -> DataFrame:
    docs = base(spark, d, "documents")
    i = F.col("doc_id")
    return docs.select(
        i.alias("comment_id"), F.col("source").alias("docket_id"), F.col("text").alias("full_text"), F.col("lang"),
        F.when(i % 7 == 0, F.concat(F.lit("Org "), (i % 50).cast("string"))).when(i % 11 == 0, "").alias("organization"),
        F.when(i % 3 == 0, F.concat(F.lit("Person "), i.cast("string"))).alias("submitter"),
        F.when(i % 4 != 0, F.col("text")).alias("body"), F.when(i % 5 == 0, F.col("text")).alias("attach_text"),
        (i % 4).cast("long").alias("n_attachments"), F.length("text").cast("long").alias("n_chars"),
    )


COMMENTS = """comments as (select doc_id as comment_id, source as docket_id, text as full_text, lang,
  case when doc_id % 7 = 0 then 'Org ' || cast(doc_id % 50 as varchar) when doc_id % 11 = 0 then '' end as organization,
  case when doc_id % 3 = 0 then 'Person ' || cast(doc_id as varchar) end as submitter,
  case when doc_id % 4 <> 0 then text end as body, case when doc_id % 5 = 0 then text end as attach_text,
  cast(doc_id % 4 as bigint) as n_attachments, cast(length(text) as bigint) as n_chars from documents)"""


def dedup(spark: SparkSession, d: str) -> DataFrame:
    """Exact families within a docket: the campaign is named after its first comment, which is also its exemplar."""
    hashed = hashes(comments(spark, d)).drop("chars")
    families = hashed.groupBy("docket_id", "exact_hash").agg(F.min("comment_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    joined = hashed.join(families, ["docket_id", "exact_hash"])
    return joined.select(
        "docket_id", "comment_id", "exact_hash",
        F.when(F.col("n") > 1, F.concat(F.lit("C"), F.col("first_id").cast("string"))).alias("campaign_id"),
        ((F.col("n") > 1) & (F.col("comment_id") == F.col("first_id"))).alias("is_exemplar"),
    )


DEDUP = """hashed as (select docket_id, comment_id,
    substr(sha256(array_to_string(regexp_extract_all(lower(coalesce(full_text, '')), '[a-z0-9'']+'), ' ')), 1, 16) as exact_hash from comments),
dedup as (select docket_id, comment_id, exact_hash,
    case when count(*) over w > 1 then 'C' || cast(min(comment_id) over w as varchar) end as campaign_id,
    count(*) over w > 1 and comment_id = min(comment_id) over w as is_exemplar
  from hashed window w as (partition by docket_id, exact_hash))"""

_ARGUMENTS = ("technical", "economic_cost", "privacy", "feasibility", "equity")
_VERDICTS = ("accepted", "partial", "rejected", "unclear")


def _pick(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], i: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{i} % {len(values)} + 1]"


def analysis(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    cited = lambda k: F.concat((F.lit(1) + (i + k) % 9).cast("string"), F.lit("."), ((i * 3 + k) % 30).cast("string"))
    return base(spark, d, "labels").select(
        i.alias("comment_id"),
        F.when(F.col("toxic") == 1, "oppose").when(i % 3 == 0, "support").when(i % 3 == 1, "mixed").alias("stance"),
        F.when(i % 13 != 0, F.least(F.lit(100), F.col("quality") * 45 + F.col("toxic") * 20 + i % 37)).cast("long").alias("significance"),
        F.to_json(F.array(_pick(_ARGUMENTS, i), _pick(_ARGUMENTS, i * 7 + 1))).alias("argument_types"),
        F.when(i % 17 == 0, "not json").otherwise(F.to_json(F.array(cited(0), cited(5), F.concat(cited(0), F.lit("(a)"))))).alias("provisions"),
        F.when(i % 5 != 0, F.col("quality") == 1).alias("novel_evidence"),
        _pick(("alpha-1", "alpha-2-x", "other", ""), i).alias("model"),
        (100 + i % 900).cast("long").alias("tokens_in"), (10 + i % 90).cast("long").alias("tokens_out"),
    )


ANALYSIS = f"""analysis as (select doc_id as comment_id,
  case when toxic = 1 then 'oppose' when doc_id % 3 = 0 then 'support' when doc_id % 3 = 1 then 'mixed' end as stance,
  case when doc_id % 13 <> 0 then cast(least(100, quality * 45 + toxic * 20 + doc_id % 37) as bigint) end as significance,
  [{_pick_sql(_ARGUMENTS, "doc_id")}, {_pick_sql(_ARGUMENTS, "(doc_id * 7 + 1)")}] as argument_types,
  case when doc_id % 17 = 0 then [] else [(1 + doc_id % 9) || '.' || (doc_id * 3 % 30), (1 + (doc_id + 5) % 9) || '.' || ((doc_id * 3 + 5) % 30),
    (1 + doc_id % 9) || '.' || (doc_id * 3 % 30) || '(a)'] end as provisions,
  case when doc_id % 5 <> 0 then quality = 1 end as novel_evidence,
  {_pick_sql(("alpha-1", "alpha-2-x", "other", ""), "doc_id")} as model,
  cast(100 + doc_id % 900 as bigint) as tokens_in, cast(10 + doc_id % 90 as bigint) as tokens_out from labels)"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    return base(spark, d, "benchmark").select(
        F.concat(F.lit("R"), i.cast("string")).alias("response_id"), F.concat(F.lit("FR-"), (i % 23).cast("string")).alias("document_id"),
        i.alias("seq"), F.col("text").alias("response_para"), F.when(i % 6 != 0, (55000 + i).cast("string")).alias("fr_page"),
    )


RESPONSES = """responses as (select 'R' || item_id as response_id, 'FR-' || (item_id % 23) as document_id, item_id as seq, text as response_para,
  case when item_id % 6 <> 0 then cast(55000 + item_id as varchar) end as fr_page from benchmark)"""


def docket_documents(spark: SparkSession, d: str) -> DataFrame:
    """One final document for each docket."""
    n = F.regexp_extract("docket_id", r"(\d+)$", 1)
    return base(spark, d, "documents").select(F.col("source").alias("docket_id")).distinct().select("docket_id", F.concat(F.lit("FR-"), n).alias("fr_doc_number"))


DOCUMENTS = """docket_documents as (select distinct source as docket_id, 'FR-' || regexp_extract(source, '(\\d+)$', 1) as fr_doc_number from documents)"""


def linkage(spark: SparkSession, d: str) -> DataFrame:
    """About a third of the analysed comments, each with one response of its docket's document."""
    i = F.col("doc_id")
    return base(spark, d, "labels").where(i % 3 == 0).select(
        i.alias("comment_id"), F.concat(F.lit("R"), (i * 5 % 37).cast("string")).alias("response_id"),
        F.when(i % 4 != 3, _pick(_VERDICTS, F.floor(i / 3))).alias("verdict"), ((i % 100) / 100.0).alias("score"),
    )


LINKAGE = f"""linkage as (select doc_id as comment_id, 'R' || (doc_id * 5 % 37) as response_id,
  case when doc_id % 4 <> 3 then {_pick_sql(_VERDICTS, "(doc_id // 3)")} end as verdict, (doc_id % 100) / 100.0 as score from labels where doc_id % 3 = 0)"""

_KINDS = ("modified", "rewritten", "added", "removed", "unchanged")


def textdiff(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return base(spark, d, "part").groupBy(
        F.concat(F.lit("src"), (k % 20).cast("string")).alias("docket_id"),
        F.concat((1 + F.floor(k / 20) % 9).cast("string"), F.lit("."), (F.floor(k / 7) % 30).cast("string")).alias("section"),
    ).agg(_pick(_KINDS, F.min("p_partkey") % 11).alias("change_kind"), (F.max("p_size") / 50.0).alias("magnitude"), F.min("p_size").cast("long").alias("words_proposed"), F.max("p_size").cast("long").alias("words_final"))


TEXTDIFF = f"""textdiff as (select 'src' || (p_partkey % 20) as docket_id, (1 + p_partkey // 20 % 9) || '.' || (p_partkey // 7 % 30) as section,
  {_pick_sql(_KINDS, "(min(p_partkey) % 11)")} as change_kind, max(p_size) / 50.0 as magnitude,
  cast(min(p_size) as bigint) as words_proposed, cast(max(p_size) as bigint) as words_final from part group by 1, 2)"""


def api_calls(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return base(spark, d, "events").select(
        "ts", F.col("event_type").alias("service"), F.concat(F.lit("/v4/"), F.col("props")).alias("endpoint"),
        F.when(i % 29 == 0, 429).when(i % 31 == 0, 500).otherwise(200).cast("long").alias("status"),
        F.when(i % 3 == 0, 1000 - i % 1000).cast("long").alias("remaining"), F.when(i % 50 == 0, 1000).cast("long").alias("limit_total"),
        F.when(i % 9 != 0, _pick(("alpha-1", "alpha-2-x", "other", ""), F.col("user_id"))).alias("model"),
        F.floor(F.col("value") * 10).cast("long").alias("tokens_in"), (i % 77).cast("long").alias("tokens_out"),
    )


API_CALLS = f"""api_calls as (select ts, event_type as service, '/v4/' || props as endpoint,
  cast(case when event_id % 29 = 0 then 429 when event_id % 31 = 0 then 500 else 200 end as bigint) as status,
  cast(case when event_id % 3 = 0 then 1000 - event_id % 1000 end as bigint) as remaining, cast(case when event_id % 50 = 0 then 1000 end as bigint) as limit_total,
  case when event_id % 9 <> 0 then {_pick_sql(("alpha-1", "alpha-2-x", "other", ""), "user_id")} end as model,
  cast(floor(value * 10) as bigint) as tokens_in, cast(event_id % 77 as bigint) as tokens_out from events)"""

CTES = {"comments": COMMENTS, "dedup": DEDUP, "analysis": ANALYSIS, "responses": RESPONSES, "docket_documents": DOCUMENTS, "linkage": LINKAGE, "textdiff": TEXTDIFF, "api_calls": API_CALLS}


def with_ctes(names: str, query: str, recursive: bool = False) -> str:
    return f"with {'recursive ' * recursive}" + ",\n".join(CTES[n] for n in names.split()) + (",\n" if not query.lstrip().startswith("select") else "\n") + query


def metrics_base(spark: SparkSession, d: str, own: DataFrame | None = None) -> DataFrame:
    """Units with their analysis, link and response; `own`: the `dedup` of these tables, where a query has it."""
    from rostrum.operators import metrics

    return metrics.base(comments(spark, d), dedup(spark, d) if own is None else own, analysis(spark, d), linkage(spark, d), responses(spark, d))


METRICS_BASE = """base as (select c.comment_id, c.docket_id, c.organization, c.submitter, c.n_chars, c.n_attachments, d.campaign_id, d.is_exemplar,
    a.stance, a.significance, a.argument_types, a.provisions, a.novel_evidence, l.response_id, l.verdict, l.score, r.fr_page
  from comments c join dedup d using (comment_id) left join analysis a using (comment_id) left join linkage l using (comment_id)
  left join responses r on r.response_id = l.response_id where d.campaign_id is null or d.is_exemplar)"""
CTES["base"] = METRICS_BASE
