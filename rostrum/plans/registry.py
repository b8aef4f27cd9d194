"""Queries by name, each with equivalent DuckDB SQL where SQL can express it.

Names start with the ids of the operator inventory that a query covers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.catalog import Catalog
from rostrum.functions import text as tx
from rostrum.operators import campaigns, console, linkage, metrics, parsing, semantic, textdiff, usage, watch
from rostrum.plans import relations as rel
from rostrum.plans.relations import with_ctes
from rostrum.sources.tables import Tables
from rostrum.storage import cut, discard, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

NOW = "2024-01-20 00:00:00"
PRICES = {"alpha": (3.0, 15.0), "alpha-2": (1.0, 5.0), "_default": (2.0, 8.0)}
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9'']+')"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# fingerprints, families, campaigns


@query(
    "T3_exact_families",
    f"""select substr(sha256(array_to_string({TOKENS.format("text")}, ' ')), 1, 16) as exact_hash,
       min(doc_id) as rep_id, count(*) as n from documents group by 1""",
)
def _(spark, d):
    hashed = rel.base(spark, d, "documents").select("doc_id", tx.exact_hash(tx.tokens(F.col("text"))).alias("exact_hash"))
    return hashed.groupBy("exact_hash").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n"))


@query("T2_token_counts", f"select doc_id, cast(len({TOKENS.format('text')}) as bigint) as n from documents")
def _(spark, d):
    return rel.base(spark, d, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n"))


_SHINGLES = """list_distinct(case when len(tok) = 0 then [] when len(tok) < 5 then [array_to_string(tok, ' ')]
   else list_transform(range(1, len(tok) - 3), lambda i: array_to_string(tok[i:i + 4], ' ')) end)"""


@query("T4_shingles", f"select doc_id, cast(len({_SHINGLES}) as bigint) as n from (select doc_id, {TOKENS.format('text')} as tok from documents)")
def _(spark, d):
    docs = rel.base(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("tok"))
    return docs.select("doc_id", F.size(tx.shingles(F.col("tok"))).cast("long").alias("n"))


def _whole(spark, d):
    """All documents as one docket."""
    return rel.comments(spark, d).withColumn("docket_id", F.lit("all"))


_PAIRS = f"""fam as (select array_to_string(tok, ' ') as k, min(doc_id) as rep, count(*) as n, any_value(tok) as tok from (select doc_id, {TOKENS.format("text")} as tok from documents) group by 1),
sh as (select rep, unnest({_SHINGLES}) as s from fam), sz as (select rep, count(*) as n from sh group by rep),
pair as (select a.rep as x, b.rep as y, count(*) as shared from sh a join sh b on a.s = b.s and a.rep <> b.rep group by 1, 2),
sized as (select x, y, shared, p.n as nx, q.n as ny from pair join sz p on p.rep = x join sz q on q.rep = y),
jac as (select x, y from sized where x < y and shared >= 0.85 * (nx + ny - shared)),
con as (select x, y from sized where nx >= 8 and ny >= 8 and ny <= 4 * nx and shared >= 0.75 * nx)"""


@query("J11_jaccard_pairs", f"with {_PAIRS} select x, y from jac")
def _(spark, d):
    return campaigns.jaccard_edges(campaigns.overlaps(campaigns.representatives(_whole(spark, d))[2])).select("x", "y")


@query("J12_U2_containment_edges", f"with {_PAIRS} select x, y from con")
def _(spark, d):
    return campaigns.containment_edges(campaigns.overlaps(campaigns.representatives(_whole(spark, d))[2])).select("x", "y")


@query(
    "U5_W3_campaigns",
    f"""with recursive {_PAIRS}, e as (select x, y from jac union select y, x from jac union select x, y from con union select y, x from con),
r(x, y) as (select rep, rep from fam union select r.x, e.y from r join e on r.y = e.x),
root as (select x, min(y) as root from r group by x)
select root, count(*) as reps, cast(sum(n) as bigint) as size from root join fam on rep = x group by root having sum(n) > 1""",
)
def _(spark, d):
    placed = campaigns.placed(*campaigns.representatives(_whole(spark, d))[1:])
    return placed.groupBy("root").agg(F.count(F.lit(1)).alias("reps"), F.sum("n").alias("size")).where("size > 1")


@query(
    "W3_campaign_numbers",
    f"""with recursive {_PAIRS}, e as (select x, y from jac union select y, x from jac union select x, y from con union select y, x from con),
r(x, y) as (select rep, rep from fam union select r.x, e.y from r join e on r.y = e.x),
root as (select x, min(y) as root from r group by x),
named as (select root, cast(sum(n) as bigint) as size from root join fam on rep = x group by root having sum(n) > 1)
select root, size, 'C' || lpad(cast(row_number() over (order by root) as varchar), 4, '0') as campaign_id from named""",
)
def _(spark, d):
    placed = campaigns.placed(*campaigns.representatives(_whole(spark, d))[1:])
    return campaigns.numbered(cut(placed.groupBy("docket_id", "root").agg(F.sum("n").alias("size")).where("size > 1"), "campaigns")).select("root", "size", "campaign_id")


@query("W4_T6_A15_dedup_table")
def _(spark, d):
    return campaigns.detect(rel.comments(spark, d))


@query("A15_dedup_summary")
def _(spark, d):
    return campaigns.summary(campaigns.detect(rel.comments(spark, d)))


# filters and projections


@query("F1_F4_docket_range", "select doc_id, n_chars from documents where source = 'src3' and n_chars between 500 and 5000")
def _(spark, d):
    docs = rel.base(spark, d, "documents")
    return docs.where((F.col("source") == "src3") & F.col("n_chars").between(500, 5000)).select("doc_id", "n_chars")


@query("F2_J1_units", with_ctes("comments dedup", "select c.comment_id, c.docket_id, d.campaign_id from comments c join dedup d using (comment_id) where d.campaign_id is null or d.is_exemplar"))
def _(spark, d):
    from rostrum.schema import units

    return units(rel.comments(spark, d).drop("docket_id"), rel.dedup(spark, d)).select("comment_id", "docket_id", "campaign_id")


@query("F3_J8_not_analyzed", with_ctes("comments", "select comment_id from comments where comment_id not in (select doc_id from labels)"))
def _(spark, d):
    return rel.comments(spark, d).join(rel.analysis(spark, d), "comment_id", "left_anti").select("comment_id")


@query("F5_changed_sections", with_ctes("textdiff", "select docket_id, section, change_kind from textdiff where change_kind in ('modified', 'rewritten', 'added', 'removed') and magnitude is not null"))
def _(spark, d):
    return rel.textdiff(spark, d).where(F.col("change_kind").isin(*metrics.CHANGED) & F.col("magnitude").isNotNull()).select("docket_id", "section", "change_kind")


@query("F6_display_name", with_ctes("comments", "select comment_id, coalesce(nullif(organization, ''), nullif(submitter, ''), 'Individual commenter') as who from comments"))
def _(spark, d):
    return rel.comments(spark, d).select("comment_id", tx.display_name(F.col("organization"), F.col("submitter")).alias("who"))


@query("F7_prefix_filter", "select doc_id from documents where source not like 'src1%'")
def _(spark, d):
    return rel.base(spark, d, "documents").where(~F.col("source").like("src1%")).select("doc_id")


@query(
    "F8_text_source",
    with_ctes("comments", """select comment_id, case when trim(coalesce(body, '')) <> '' and trim(coalesce(attach_text, '')) <> '' then 'both'
  when trim(coalesce(attach_text, '')) <> '' then 'attachment' when trim(coalesce(body, '')) <> '' then 'inline' else 'empty' end as text_source from comments"""),
)
def _(spark, d):
    return rel.comments(spark, d).select("comment_id", tx.text_source(F.col("body"), F.col("attach_text")).alias("text_source"))


@query("F9_T23_model_route", with_ctes("comments", "select comment_id, len(regexp_extract_all(full_text, '\\S+')) as words, case when len(regexp_extract_all(full_text, '\\S+')) >= 400 or coalesce(organization, '') <> '' then 'deep' else 'triage' end as route from comments"))
def _(spark, d):
    words = tx.word_count(F.col("full_text"))
    return rel.comments(spark, d).select("comment_id", words.cast("long").alias("words"), tx.model_route(words, F.col("organization")).alias("route"))


# metrics over units

_B = "comments dedup analysis linkage responses base"


@query("J2_J3_N8_metrics_base", with_ctes(_B, "select comment_id, docket_id, campaign_id, significance, stance, response_id, verdict, fr_page from base"))
def _(spark, d):
    return rel.metrics_base(spark, d).select("comment_id", "docket_id", "campaign_id", "significance", "stance", "response_id", "verdict", "fr_page")


@query(
    "A7_A9_shape",
    with_ctes(_B, """select docket_id, count(*) as units, count(significance) as analyzed, cast(count(*) filter (n_attachments > 0) as bigint) as with_attachments,
  count(campaign_id) as campaigns, cast(floor(quantile_cont(n_chars, 0.5)) as bigint) as median_chars, count(response_id) as linked,
  round(avg(case when response_id is not null then 1.0 else 0.0 end), 4) as response_rate from base group by docket_id"""),
)
def _(spark, d):
    return metrics.shape(rel.metrics_base(spark, d))


@query("A6_stance_histogram", with_ctes(_B, "select docket_id, stance as value, count(*) as n from base where stance is not null group by all"))
def _(spark, d):
    return metrics.histogram(rel.metrics_base(spark, d), "stance")


@query(
    "A10_significance_bands",
    with_ctes(_B, """select docket_id, band, count(b.comment_id) as n, cast(count(b.response_id) as bigint) as answered,
  case when count(b.comment_id) > 0 then round(count(b.response_id) * 1.0 / count(b.comment_id), 4) end as rate
from (select distinct docket_id from base) k cross join (values ('0-19', 0, 19), ('20-39', 20, 39), ('40-59', 40, 59), ('60-79', 60, 79), ('80-100', 80, 100)) v(band, lo, hi)
left join base b using (docket_id) """).replace("left join base b using (docket_id) ", "left join base b on b.docket_id = k.docket_id and b.significance between lo and hi group by k.docket_id, band").replace("select docket_id, band, count", "select k.docket_id, band, count"),
)
def _(spark, d):
    return metrics.by_band(rel.metrics_base(spark, d))


@query(
    "A11_T19_by_argument",
    with_ctes(_B, """select *, round(answered * 1.0 / n, 4) as rate, n < 10 as thin, case when answered > 0 then round((accepted + 0.5 * partial) / answered, 4) end as win from (
  select docket_id, type, count(*) as n, count(response_id) as answered, cast(count(*) filter (response_id is not null and verdict = 'accepted') as bigint) as accepted,
    cast(count(*) filter (response_id is not null and verdict = 'partial') as bigint) as partial, cast(count(*) filter (response_id is not null and verdict = 'rejected') as bigint) as rejected
  from (select docket_id, response_id, verdict, unnest(argument_types) as type from base where significance is not null) group by all)"""),
)
def _(spark, d):
    return metrics.by_argument(rel.metrics_base(spark, d))


@query(
    "A12_contested_provisions",
    with_ctes(_B, """select * from (select docket_id, provision, n, answered, row_number() over (partition by docket_id order by n desc, provision) as place from (
  select docket_id, provision, count(*) as n, count(response_id) as answered from (select docket_id, response_id, unnest(list_distinct(provisions)) as provision from base where significance is not null) group by all)) where place <= 12"""),
)
def _(spark, d):
    return metrics.contested_provisions(rel.metrics_base(spark, d))


@query("A13_evidence", with_ctes(_B, "select docket_id, coalesce(novel_evidence, false) as with_evidence, count(*) as n, round(count(response_id) * 1.0 / count(*), 4) as rate from base where significance is not null group by all"))
def _(spark, d):
    return metrics.evidence(rel.metrics_base(spark, d))


@query(
    "A24_J4_orphans",
    with_ctes("responses docket_documents linkage", "select docket_id, count(*) as orphans from responses r join docket_documents d on d.fr_doc_number = r.document_id where not exists (select 1 from linkage l where l.response_id = r.response_id) group by docket_id"),
)
def _(spark, d):
    return metrics.orphans(rel.responses(spark, d), rel.docket_documents(spark, d), rel.linkage(spark, d))


_MOVED = """moved as (select docket_id, section, coalesce(magnitude, 0.0) as m, row_number() over (partition by docket_id order by coalesce(magnitude, 0.0), section) as place,
    count(*) over (partition by docket_id) as total from textdiff where change_kind <> 'unchanged'),
tot as (select docket_id, count(*) as sections from textdiff group by docket_id),
flo as (select t.docket_id, case when total * 1.0 / sections >= 0.8 and total >= 4 then m else 0.0 end as floor from tot t left join moved on moved.docket_id = t.docket_id and place = floor(total * 0.6) + 1)"""


@query(
    "A8_A16_diff_summary",
    with_ctes("textdiff", _MOVED + """ select t.docket_id, sections, coalesce(total, 0) as changed, round(coalesce(total, 0) * 1.0 / sections, 4) as change_rate, coalesce(round(m, 4), 0.0) as median_magnitude,
  coalesce(total, 0) * 1.0 / sections < 0.8 as discriminating from tot t left join moved on moved.docket_id = t.docket_id and place = total // 2 + 1"""),
)
def _(spark, d):
    return metrics.diff_summary(rel.textdiff(spark, d))


@query("W9_standout_floor", with_ctes("textdiff", _MOVED + " select docket_id, floor from flo"))
def _(spark, d):
    return metrics.standout_floor(rel.textdiff(spark, d))


_OUTCOME = _MOVED + """, cited as (select docket_id, comment_id, nullif(regexp_extract(p, '^(\\d{1,3}\\.\\d{1,3})', 1), '') as section from (select docket_id, comment_id, unnest(provisions) as p from base)),
outcome as (select c.docket_id, c.comment_id, count(*) as n, round(max(m), 3) as top_magnitude from cited c join moved using (docket_id, section) join flo f on f.docket_id = c.docket_id where m >= f.floor group by 1, 2)"""


@query("J15_N9_T12_outcome_map", with_ctes(_B + " textdiff", _OUTCOME + " select * from outcome"))
def _(spark, d):
    return metrics.outcome_map(rel.metrics_base(spark, d), rel.textdiff(spark, d))


@query(
    "A14_outcome_grid",
    with_ctes(_B + " textdiff", _OUTCOME + """ select docket_id, cast(count(*) filter (response_id is not null and o.comment_id is not null) as bigint) as answered_changed, cast(count(*) filter (response_id is not null and o.comment_id is null) as bigint) as answered_only,
  cast(count(*) filter (response_id is null and o.comment_id is not null) as bigint) as changed_only, cast(count(*) filter (response_id is null and o.comment_id is null) as bigint) as neither
from base b left join (select comment_id from outcome) o using (comment_id) group by docket_id""").replace("o.comment_id is", "o.k is").replace("(select comment_id from outcome)", "(select comment_id, 1 as k from outcome)"),
)
def _(spark, d):
    base = rel.metrics_base(spark, d)
    return metrics.outcome_grid(base, metrics.outcome_map(base, rel.textdiff(spark, d)))


_WHO = "coalesce(nullif(organization, ''), nullif(submitter, ''), 'Individual commenter') as who"


@query(
    "W5_silent_wins",
    with_ctes(_B + " textdiff", _OUTCOME + f""" select * from (select b.docket_id, comment_id, {_WHO}, top_magnitude,
  row_number() over (partition by b.docket_id order by top_magnitude desc, coalesce(significance, 0) desc, comment_id) as place from base b join (select comment_id, top_magnitude from outcome) using (comment_id) where response_id is null) where place <= 15"""),
)
def _(spark, d):
    base = rel.metrics_base(spark, d)
    return metrics.silent_wins(base, metrics.outcome_map(base, rel.textdiff(spark, d)))


@query(
    "W6_unanswered_significant",
    with_ctes(_B, f"select * from (select docket_id, comment_id, {_WHO}, significance, row_number() over (partition by docket_id order by significance desc, comment_id) as place from base where response_id is null and significance >= 60) where place <= 20"),
)
def _(spark, d):
    return metrics.unanswered_significant(rel.metrics_base(spark, d))


@query(
    "J5_W7_N10_ledger",
    with_ctes(_B, f"""select docket_id, comment_id, {_WHO}, size, significance, response_id is not null as answered,
  cast(greatest(2, round(100.0 * size / max(size) over (partition by docket_id))) as bigint) as bar,
  row_number() over (partition by docket_id order by response_id is not null, coalesce(significance, 0) desc, size desc, comment_id) as place
from (select base.*, coalesce(n, 1) as size from base left join (select docket_id, campaign_id, count(*) as n from dedup where campaign_id is not null group by all) using (docket_id, campaign_id))"""),
)
def _(spark, d):
    own = rel.dedup(spark, d)
    return metrics.ledger(rel.metrics_base(spark, d, own), metrics.campaign_sizes(own))


def _ledger_sql(order: str) -> str:
    return with_ctes(_B, f"""select docket_id, comment_id, {_WHO}, size, significance, response_id is not null as answered,
  cast(greatest(2, round(100.0 * size / max(size) over (partition by docket_id))) as bigint) as bar,
  row_number() over (partition by docket_id order by {order}, comment_id) as place
from (select base.*, coalesce(n, 1) as size from base left join (select docket_id, campaign_id, count(*) as n from dedup where campaign_id is not null group by all) using (docket_id, campaign_id))""")


@query("W7_ledger_by_weight", _ledger_sql("size desc"))
def _(spark, d):
    own = rel.dedup(spark, d)
    return metrics.ledger(rel.metrics_base(spark, d, own), metrics.campaign_sizes(own), "weight")


@query("W7_ledger_by_significance", _ledger_sql("coalesce(significance, 0) desc"))
def _(spark, d):
    own = rel.dedup(spark, d)
    return metrics.ledger(rel.metrics_base(spark, d, own), metrics.campaign_sizes(own), "significance")


@query(
    "M5_linkage_summary",
    with_ctes(_B, """select docket_id, coalesce(any_value(parsed), 0) as responses_parsed, count(*) as units, count(response_id) as linked, count(*) - count(response_id) as unlinked,
  count(*) filter (response_id is null and coalesce(significance, 0) >= 60) as high_significance_unanswered, 0::bigint as adjudicated_pairs,
  round(count(response_id) / count(*), 4) as response_rate
from base left join (select docket_id, count(*) as parsed from comments group by docket_id) p using (docket_id) group by docket_id"""),
)
def _(spark, d):
    units = rel.metrics_base(spark, d)
    links = units.where("response_id is not null").select("comment_id", F.lit("embedding").alias("method"))
    return linkage.run_summary(units, links, rel.comments(spark, d))


@query("S3_scalar", "select count(*) as n, max(o_totalprice) as top from orders where o_orderstatus = 'F'")
def _(spark, d):
    found = Catalog(spark, {"orders": rel.base(spark, d, "orders")})
    ask = lambda what: found.scalar(f"select {what} from orders where o_orderstatus = ?", ["F"])
    return spark.createDataFrame([(ask("count(*)"), ask("max(o_totalprice)"))], "n long, top double")


@query(
    "K1_upsert",
    """with o as (select 'd' || cast(o_custkey as varchar) as docket_id, o_orderkey from orders)
select docket_id, coalesce(max(cast(o_orderkey as varchar)) filter (o_orderkey % 2 = 1), max(cast(o_orderkey as varchar))) as title from o group by docket_id""",
)
def _(spark, d):
    """Dockets stored twice: those of even orders, then those of odd ones, which replace them."""
    orders = rel.base(spark, d, "orders").select(F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("docket_id"), F.col("o_orderkey").cast("string").alias("title"), "o_orderkey")
    tables = Tables(spark, new_path(spark, "tables"))
    for rest in (0, 1):
        tables.upsert("dockets", orders.where(F.col("o_orderkey") % 2 == rest).select("docket_id", "title"), "title")
    return tables.read("dockets").select("docket_id", "title")


@query("K2_refresh", "select s_name as docket_id, 'new' as section, count(*) as n from supplier where s_suppkey % 3 = 1 group by 1 union all select s_name, 'old', count(*) from supplier where s_suppkey % 3 = 2 group by 1")
def _(spark, d):
    """Sections of dockets, stored, then refreshed for two thirds of the dockets, of which half have new rows and half none."""
    rows = rel.base(spark, d, "supplier").select(F.col("s_name").alias("docket_id"), (F.col("s_suppkey") % 3).alias("k"))
    tables = Tables(spark, new_path(spark, "tables"))
    tables.refresh("textdiff", rows.select("docket_id", F.lit("old").alias("section")))
    tables.refresh("textdiff", rows.where("k = 1").select("docket_id", F.lit("new").alias("section")), rows.where("k < 2").select("docket_id"))
    return tables.read("textdiff").groupBy("docket_id", "section").agg(F.count(F.lit(1)).alias("n"))


@query(
    "W8_report_ledger",
    with_ctes(_B, "select comment_id, significance from base order by significance desc nulls last, comment_id limit 1500"),
)
def _(spark, d):
    return rel.metrics_base(spark, d).select("comment_id", "significance").orderBy(F.col("significance").desc_nulls_last(), "comment_id").limit(1500)


@query("W14_longest_first", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 100")
def _(spark, d):
    return rel.base(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)


@query(
    "A3_tokens",
    with_ctes("comments analysis", "select docket_id, cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out, cast(round(sum(tokens_in + tokens_out) * 1.0 / count(*)) as bigint) as per_unit from analysis join comments using (comment_id) group by docket_id"),
)
def _(spark, d):
    return metrics.tokens(rel.analysis(spark, d), rel.comments(spark, d))


@query(
    "A1_A2_docket_stats",
    with_ctes("comments dedup analysis linkage", """select c.docket_id, count(distinct c.comment_id) as comments, count(distinct campaign_id) as campaigns, cast(count(*) filter (campaign_id is null or is_exemplar) as bigint) as units,
  count(a.comment_id) as analyzed, count(l.comment_id) as linked, cast(coalesce(sum(tokens_in), 0) as bigint) as tokens_in
from comments c left join dedup d on d.comment_id = c.comment_id left join analysis a on a.comment_id = c.comment_id left join linkage l on l.comment_id = c.comment_id group by c.docket_id"""),
)
def _(spark, d):
    return metrics.docket_stats(rel.comments(spark, d), rel.dedup(spark, d), rel.analysis(spark, d), rel.linkage(spark, d))


@query("J7_comment_counts", with_ctes("docket_documents", "select docket_id, fr_doc_number, (select count(*) from documents c where c.source = d.docket_id) as n from docket_documents d"))
def _(spark, d):
    counts = rel.comments(spark, d).groupBy("docket_id").agg(F.count(F.lit(1)).alias("n"))
    return rel.docket_documents(spark, d).join(counts, "docket_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("A5_page_span", with_ctes("responses", "select document_id, count(*) as n, min(fr_page) as first_page, max(fr_page) as last_page from responses group by document_id"))
def _(spark, d):
    return rel.responses(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.min("fr_page").alias("first_page"), F.max("fr_page").alias("last_page"))


@query(
    "A25_U1_U3_sets",
    """with l as (select source, lang from documents where doc_id in (select doc_id from labels)), u as (select source, lang from documents where doc_id not in (select doc_id from labels))
select source, lang, 'both' as kind from (select * from l intersect select * from u) union all select source, lang, 'labelled only' as kind from (select * from l except select * from u)
union all select source, lang, 'unlabelled only' as kind from (select * from u except select * from l)""",
)
def _(spark, d):
    docs, labels = rel.base(spark, d, "documents"), rel.base(spark, d, "labels").select("doc_id")
    labelled, rest = (docs.join(labels, "doc_id", how).select("source", "lang") for how in ("left_semi", "left_anti"))
    kinds = {"both": labelled.intersect(rest), "labelled only": labelled.subtract(rest), "unlabelled only": rest.subtract(labelled)}
    return reduce(DataFrame.unionAll, (df.withColumn("kind", F.lit(k)) for k, df in kinds.items()))


@query(
    "J10_U1_section_union",
    with_ctes("textdiff", """n as (select cast(substr(docket_id, 4) as int) as docket, section from textdiff)
select coalesce(a.docket, b.docket) as docket, coalesce(a.section, b.section) as section, case when a.section is null then 'added' when b.section is null then 'removed' else 'both' end as kind
from n a full join (select (docket + 19) % 20 as docket, section from n) b on a.section = b.section and a.docket = b.docket"""),
)
def _(spark, d):
    """Each docket's sections with the next one's."""
    n = rel.textdiff(spark, d).select(F.substring("docket_id", 4, 9).cast("int").alias("docket"), "section")
    a, b = n.withColumn("a", F.lit(1)), n.select(((F.col("docket") + 19) % 20).alias("docket"), "section", F.lit(1).alias("b"))
    return a.join(b, ["docket", "section"], "full").select("docket", "section", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("both").alias("kind"))


def _two_versions(spark, d):
    """The documents in pairs of ids, 20 dockets of sections: the first of a pair is the proposal, the second the final text."""
    i = F.col("doc_id")
    k = F.floor(i / 2)
    section = F.concat((1 + F.floor(k / 20 / 900)).cast("string"), F.lit("."), (F.floor(k / 20) % 900).cast("string"))
    docs = rel.base(spark, d, "documents").select(F.concat(F.lit("src"), (k % 20).cast("string")).alias("docket_id"), section.alias("section"), F.col("text").alias("body"), (i % 2).alias("version"))
    return docs.where("version = 0").drop("version"), docs.where("version = 1").drop("version")


@query("J10_T7_compare")
def _(spark, d):
    return cut(textdiff.compare(*_two_versions(spark, d)), "compared")


def _rule_texts(spark, d):
    """Each document as a rule of two sections, the second of which stands twice."""
    i = F.col("doc_id")
    number = F.concat((1 + i % 9).cast("string"), F.lit("."), (i % 30).cast("string"))
    text = F.concat(F.lit("Preamble of § 9.9 and more.\nList of Subjects in 32 CFR Part 170\n§ "), number, F.lit("  Purpose.\n"), F.coalesce("text", F.lit("")), F.lit("\n§ "), number, F.lit("1\nScope.\nShort.\n§ "), number, F.lit("1\nScope.\nLonger text.\n"))
    return rel.base(spark, d, "documents").select(i.cast("string").alias("docket_id"), text.alias("text"))


@query("T8_T9_W10_sections")
def _(spark, d):
    return textdiff.split(_rule_texts(spark, d))


@query("T10_diagnosis")
def _(spark, d):
    return cut(_rule_texts(spark, d).select("docket_id", parsing.diagnosis("text").alias("d")).select("docket_id", "d.*"), "diagnosed")


@query(
    "W17_section_order",
    with_ctes("textdiff", "select section, cast(split_part(section, '.', 1) as double) * 1000 + cast(split_part(section, '.', 2) as double) as sort_key from (select distinct section from textdiff)"),
)
def _(spark, d):
    return rel.textdiff(spark, d).select("section").distinct().withColumn("sort_key", tx.sort_key(F.col("section")))


# usage


@query(
    "K6_record",
    """select ts, event_type as service, substr('/v4/' || repeat(props, 9), 1, 120) as endpoint, 200 + event_id % 3 as status, case when event_id % 3 = 0 then cast(event_id % 1000 as int) end as remaining,
  case when event_id % 4 <> 1 then 1000 end as limit_total, case when event_id % 5 <> 0 then 'alpha-1' end as model, case when event_id % 7 = 0 then 0 else cast(user_id as bigint) end as tokens_in, event_id % 77 as tokens_out from events""",
)
def _(spark, d):
    i = F.col("event_id")
    headers = F.create_map(
        F.lit("X-RateLimit-Remaining"), F.when(i % 3 == 0, (i % 1000).cast("string")).otherwise("n/a"),
        F.when(i % 2 == 0, "x-ratelimit-limit").otherwise("X-RateLimit-Limit"), F.when(i % 4 == 1, "").otherwise("1000"),
    )
    return usage.record(rel.base(spark, d, "events").select(
        "ts", F.col("event_type").alias("service"), F.concat(F.lit("/v4/"), F.repeat("props", 9)).alias("endpoint"), (200 + i % 3).alias("status"), headers.alias("headers"),
        F.when(i % 5 == 0, "").otherwise("alpha-1").alias("model"), F.when(i % 7 != 0, F.col("user_id").cast("long")).alias("tokens_in"), (i % 77).alias("tokens_out"),
    ))


@query("W15_recent_calls", with_ctes("api_calls", "select ts, service, endpoint from api_calls order by ts desc, service, endpoint limit 25"))
def _(spark, d):
    return usage.recent(rel.api_calls(spark, d)).select("ts", "service", "endpoint")


_Q = f"timestamp '{NOW}'"


@query(
    "A18_N1_quota",
    with_ctes("api_calls", f"""select service, used, lim as "limit", coalesce(reported, greatest(lim - used, 0)) as remaining, case when reported is not null then 'server header' else 'local count' end as source, throttled,
  round(100.0 * coalesce(reported, greatest(lim - used, 0)) / lim, 1) as pct, greatest(cast(floor(epoch(oldest + interval 72 hour) - epoch({_Q})) as bigint), 0) as resets_in from (
  select service, count(*) as used, coalesce(max_by(limit_total, (ts, limit_total)) filter (limit_total is not null), 950) as lim, max_by(remaining, (ts, remaining)) filter (remaining is not null) as reported,
    cast(count(*) filter (status = 429) as bigint) as throttled, min(ts) as oldest from api_calls where ts >= {_Q} - interval 72 hour group by service)"""),
)
def _(spark, d):
    return usage.quota(rel.api_calls(spark, d), F.lit(NOW).cast("timestamp_ntz"), hours=72)


@query(
    "A4_J17_N2_N4_spend",
    with_ctes("api_calls", """select model, calls, tokens_in, tokens_out, round(tokens_in / 1e6 * pi + tokens_out / 1e6 * po, 4) as cost from (
  select model, count(*) as calls, cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out, case when starts_with(model, 'alpha') then 3.0 else 2.0 end as pi, case when starts_with(model, 'alpha') then 15.0 else 8.0 end as po
  from api_calls where coalesce(model, '') <> '' and ts >= timestamp '2024-01-05' group by model)"""),
)
def _(spark, d):
    return usage.spend(rel.api_calls(spark, d), usage.prices(spark, PRICES), F.lit("2024-01-05").cast("timestamp_ntz"))


@query(
    "A20_preflight",
    with_ctes("comments", "select docket_id, comments, n as requests, round(n / 950.0, 2) as hours, case when n <= 950 then 'fits' when n <= 5000 then 'hours' else 'mirror' end as verdict from (select docket_id, comments, cast(comments + greatest(1, comments // 250) + 3 as bigint) as n from (select docket_id, count(*) * 37 as comments from comments group by 1))"),
)
def _(spark, d):
    return usage.preflight(rel.comments(spark, d).groupBy("docket_id").agg((F.count(F.lit(1)) * 37).alias("comments")))


@query(
    "A19_N3_estimate",
    with_ctes("comments dedup analysis", """p as (select docket_id, count(*) as pulled from comments group by 1), u as (select docket_id, count(*) as units from dedup where campaign_id is null or is_exemplar group by 1),
a as (select docket_id, count(*) as analyzed, sum(tokens_in * case when starts_with(model, 'alpha') then 3e0 else 2e0 end + tokens_out * case when starts_with(model, 'alpha') then 15e0 else 8e0 end) as spent from analysis join comments using (comment_id) group by 1),
x as (select docket_id, pulled, coalesce(units, 0) as units, coalesce(analyzed, 0) as analyzed, spent, case when analyzed > 0 then round(spent / analyzed) / 1e6 end as e, pulled * 3 as total from p left join u using (docket_id) left join a using (docket_id))
select docket_id, pulled, units, analyzed, round(coalesce(spent, 0e0) / 1e6, 4) as spent_analysis, e as per_unit_cost, greatest(units - analyzed, 0) as units_remaining, round(greatest(units - analyzed, 0) * e, 4) as cost_to_finish_pulled,
  cast(round(total * units * 1.0 / pulled) as bigint) as projected_units, round(1 - units * 1.0 / pulled, 4) as collapse_ratio, round(round(total * units * 1.0 / pulled) * e * 1.9, 2) as projected_total,
  cast(total + greatest(1, total // 250) + 3 as bigint) as api_requests from x"""),
)
def _(spark, d):
    comments, dedup = rel.comments(spark, d), rel.dedup(spark, d)
    totals = comments.groupBy("docket_id").agg((F.count(F.lit(1)) * 3).alias("total_comments"))
    return usage.estimate(comments, dedup.where("campaign_id is null or is_exemplar"), rel.analysis(spark, d), usage.prices(spark, PRICES), totals)


# linkage and clusters on vectors


def _vectors(spark, d):
    """All rows, and those of ids divisible by 100 as the query set."""
    e = rel.base(spark, d, "embeddings")
    left = e.select(F.col("vec_id").alias("comment_id"), F.col("embedding").alias("vector"))
    return left, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("response_id"), F.col("embedding").alias("vector"))


def _link_sql(top: int = 1) -> str:
    return f"""select comment_id, response_id, round(score, 6) as score from (select *, avg(score) over w as mu, stddev_pop(score) over w as sd, count(*) over w as n,
  row_number() over (partition by comment_id order by score desc, response_id) as place from (select a.vec_id as comment_id, b.vec_id as response_id,
    list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) as score from embeddings a, embeddings b where b.vec_id % 100 = 0) window w as (partition by comment_id))
where place <= {top} and score >= 0.05 and not (n >= 4 and sd > 1e-6 and (score - mu) / sd < 1.5)"""


@query("J13_W1_W2_A22_linkage", _link_sql())
def _(spark, d):
    return linkage.link(*_vectors(spark, d)).select("comment_id", "response_id", F.round("score", 6).alias("score"))


@query("M5_linkage_selective", _link_sql(3))
def _(spark, d):
    return linkage.link(*_vectors(spark, d), top=3).select("comment_id", "response_id", F.round("score", 6).alias("score"))


@query(
    "A21_medoids",
    """with x as (select label, vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings), c as (select label, i, avg(cast(v as double)) as c from x group by 1, 2),
s as (select label, vec_id, sum(v * c) as s from x join c using (label, i) group by 1, 2) select label, vec_id as medoid, round(s, 5) as s from (select *, row_number() over (partition by label order by round(s, 9) desc, vec_id) as k from s) where k = 1""",
)
def _(spark, d):
    e = rel.base(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return linkage.medoids(e).select("label", F.col("medoid"), F.round("score", 5).alias("s"))


def _units(spark, d):
    units = rel.comments(spark, d).join(rel.dedup(spark, d).drop("docket_id"), "comment_id").where("campaign_id is null or is_exemplar")
    return units.select("docket_id", F.col("comment_id").alias("id"), F.col("full_text").alias("text"))


@query("M1_reduced_vectors")
def _(spark, d):
    return semantic.reduced_rows(linkage.tfidf_rows(_units(spark, d)))


@query("M1_M3_M4_clusters")
def _(spark, d):
    texts = _units(spark, d)
    rows = linkage.tfidf_rows(texts)
    # reckoned in 32 bits, of which the written vectors keep as many
    vectors = cut(semantic.reduced_rows(rows).withColumn("vector", F.col("vector").cast("array<float>")), "vectors")
    discard(rows)
    return linkage.placed(vectors, texts.select("docket_id", "id"))


@query("M3_average_linkage")
def _(spark, d):
    """On the given vectors, a docket for each label."""
    e = rel.base(spark, d, "embeddings").select(F.col("label").cast("string").alias("docket_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    # reckoned once for a vector: within a lambda it would be for each number
    lengths = F.array_repeat(length, F.size("vector"))
    return semantic.average_linkage(e.withColumn("vector", F.zip_with("vector", lengths, lambda x, n: x.cast("double") / n)))


# parsing


@query(
    "T15_F10_turn_pairs",
    """select conv_id, turn, text as comment_para, response_para from (select *, lead(role) over w as next_role, lead(text) over w as response_para from conversations window w as (partition by conv_id order by turn))
where role = 'user' and next_role = 'assistant' and length(text) between 40 and 20000 and length(response_para) between 40 and 20000""",
)
def _(spark, d):
    return parsing.turn_pairs(rel.base(spark, d, "conversations"))


@query(
    "T15_structural_pairs",
    """with p as (select conv_id, turn, role, text, count(*) filter (role in ('user', 'assistant')) over (partition by conv_id order by turn) as run from conversations),
g as (select conv_id, run, min_by(role, turn) as role, min(turn) as turn, trim(string_agg(trim(text), ' ' order by turn)) as side from p where run > 0 group by 1, 2),
n as (select *, lead(role) over w as nr, lead(side) over w as ns from g window w as (partition by conv_id order by run))
select cast(conv_id as varchar) as document_id, row_number() over (partition by conv_id order by turn) as seq, cast(length(side) as bigint) as c, cast(length(ns) as bigint) as r from n
where role = 'user' and nr = 'assistant' and length(side) between 40 and 20000 and length(ns) between 40 and 20000""",
)
def _(spark, d):
    turns = rel.base(spark, d, "conversations")
    label = F.when(F.col("role") == "user", "Comment: ").when(F.col("role") == "assistant", "Response: ").otherwise("")
    paragraphs = turns.select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("pos"), F.concat(label, F.trim("text")).alias("text"))
    return parsing.structural_pairs(paragraphs).select("document_id", "seq", F.length("comment_para").cast("long").alias("c"), F.length("response_para").cast("long").alias("r"))


@query("T16_T17_S10_parse_responses")
def _(spark, d):
    turns = rel.base(spark, d, "conversations")
    label = F.when(F.col("role") == "user", "Comment: ").when(F.col("role") == "assistant", "Response: ").otherwise("")
    page = F.concat(F.lit("[[Page "), (55000 + F.col("turn")).cast("string"), F.lit("]]\n"))
    parts = turns.groupBy(F.col("conv_id").cast("string").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(page, label, F.col("text")).alias("t")))).alias("parts"))
    docs = parts.select("document_id", F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n").alias("text"), F.lit(None).cast("string").alias("xml"))
    return parsing.parse_responses(docs)


@query(
    "J14_page_as_of",
    """select l.l_orderkey as pos, l.l_linenumber as n, p.p_name as page from lineitem l asof left join (select cast(p_partkey * 7 as bigint) as pos, p_name from part) p on l.l_orderkey >= p.pos""",
)
def _(spark, d):
    at = rel.base(spark, d, "lineitem").select(F.lit("x").alias("document_id"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("n"))
    marks = rel.base(spark, d, "part").select(F.lit("x").alias("document_id"), (F.col("p_partkey") * 7).alias("pos"), F.col("p_name").alias("page"))
    return parsing.page_at(at, marks).select("pos", "n", "page")


@query(
    "T1_strip_stage",
    """select page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'gsi'), '<br\\s*/?>', chr(10), 'gi'), '</p\\s*>', chr(10) || chr(10), 'gi'), '<[^>]{1,400}>', ' ', 'g')) as h from pages""",
)
def _(spark, d):
    return rel.base(spark, d, "pages").select("page_id", F.md5(tx.strip_markup(F.col("html")).cast("binary")).alias("h"))


@query("T1_normalize")
def _(spark, d):
    return rel.base(spark, d, "pages").select("page_id", tx.normalize(F.col("html")).alias("text"))


_IDS = """case doc_id % 6 when 0 then 'Docket No. ' || 'DARS-2020-00' || doc_id when 1 then '"cms-2024-' || doc_id || '"' when 2 then 'RIN: abc' when 3 then 'Docket ID: EPA–HQ–OAR–2021–' || (doc_id % 1000) || ', Sequence No. 1' when 4 then '' else cast(doc_id as varchar) end"""


@query(
    "T13_normalize_id",
    f"""select doc_id, nullif(regexp_extract(upper(replace(replace(trim(regexp_replace(split_part(regexp_replace(trim(raw), '^["'']+|["'']+$', '', 'g'), ',', 1),
  '^\\s*(?:docket\\s*(?:id|no\\.?|number)?\\s*[:\\-]?\\s*|regulations\\.gov\\s*[:\\-]?\\s*|rin\\s*[:\\-]?\\s*)+', '', 'i')), '–', '-'), '—', '-')), '[A-Z][A-Z0-9]{{1,9}}(?:-[A-Z0-9]{{1,6}}){{1,4}}'), '') as docket from (select doc_id, {_IDS} as raw from documents)""",
)
def _(spark, d):
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    raw = (
        F.when(i % 6 == 0, F.concat(F.lit("Docket No. DARS-2020-00"), s)).when(i % 6 == 1, F.concat(F.lit('"cms-2024-'), s, F.lit('"'))).when(i % 6 == 2, "RIN: abc")
        .when(i % 6 == 3, F.concat(F.lit("Docket ID: EPA–HQ–OAR–2021–"), (i % 1000).cast("string"), F.lit(", Sequence No. 1"))).when(i % 6 == 4, "").otherwise(s)
    )
    return rel.base(spark, d, "documents").select("doc_id", tx.normalize_id(raw).alias("docket"))


@query("T14_filter_date", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from events")
def _(spark, d):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit(".123Z"))
    return rel.base(spark, d, "events").select("event_id", tx.filter_date(iso).alias("at"))


@query(
    "T11_provisions",
    """select p_partkey, list_filter([k || '.' || m, case when p_partkey % 2 = 0 then k || '.' || m || '(c)(4)' end, case when p_partkey % 4 = 0 then 'NIST SP 800-' || k end], lambda x: x is not null) as cited
from (select p_partkey, 1 + p_partkey % 200 as k, p_size as m from part)""",
)
def _(spark, d):
    k, m = (1 + F.col("p_partkey") % 200).cast("string"), F.col("p_size").cast("string")
    dot = F.concat(k, F.lit("."), m)
    raw = F.array(
        F.concat(F.lit(" § "), dot, F.lit(" ,;")), F.lit("https://x.y/1.2"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Section  "), dot, F.lit("(c)(4)"))),
        F.lit("p-12"), F.lit("something else"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("NIST  SP 800-"), k)), dot,
    )
    return rel.base(spark, d, "part").select("p_partkey", tx.clean_provisions(raw).alias("cited"))


@query(
    "T21_T22_pages_caution",
    """select p_partkey, greatest(coalesce(case when p_partkey % 5 = 0 then null else p_size end - (case when p_partkey % 7 = 0 then 0 else 3 end) + 1, 0), 0) as pages,
  case when p_size % 40 = 0 then 'no data' when p_size % 40 < 10 then 'n=' || (p_size % 40) || ' — too few to read as a rate' when p_size % 40 < 30 then 'n=' || (p_size % 40) || ' — indicative only' end as caution from part""",
)
def _(spark, d):
    end = F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.col("p_size").cast("string"))
    start = F.when(F.col("p_partkey") % 7 == 0, "").otherwise("3")
    return rel.base(spark, d, "part").select("p_partkey", tx.pages(start, end).alias("pages"), tx.caution(F.col("p_size") % 40).alias("caution"))


@query("T24_T26_mask_caps", "select c_custkey, case when length(c_name) > 4 then '…' || right(c_name, 4) when length(c_name) > 0 then '…' end as masked, substr(c_name, 1, 6) as short from customer")
def _(spark, d):
    return rel.base(spark, d, "customer").select("c_custkey", tx.mask(F.col("c_name")).alias("masked"), F.substring("c_name", 1, 6).alias("short"))


@query("T18_model_json", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def _(spark, d):
    answer = F.concat(F.when(F.col("event_id") % 2 == 0, "```json\n").otherwise("Here it is: "), F.col("props"), F.when(F.col("event_id") % 2 == 0, "\n```").otherwise(" Done."))
    return rel.base(spark, d, "events").select("event_id", F.try_variant_get(tx.model_json(answer), "$.k", "bigint").alias("k"))


_FR = """fr as (select 'src' || (p_partkey % 20) as docket_id, 'D' || p_partkey as document_number, case when p_partkey % 2 = 0 then 'Rule' else 'Proposed Rule' end as type,
  case p_partkey % 7 when 0 then 'Final rule; correction' when 1 then 'Interim final rule.' when 2 then 'Supplemental notice of proposed rulemaking' when 3 then '' else 'Final rule.' end as action,
  date '2020-01-01' + cast(p_size * 7 as integer) as publication_date, 100 as start_page, 100 + p_size * (1 + p_partkey % 3) as end_page from part)"""


def _federal(spark, d):
    k = F.col("p_partkey")
    action = F.when(k % 7 == 0, "Final rule; correction").when(k % 7 == 1, "Interim final rule.").when(k % 7 == 2, "Supplemental notice of proposed rulemaking").when(k % 7 == 3, "").otherwise("Final rule.")
    return rel.base(spark, d, "part").select(
        F.concat(F.lit("src"), (k % 20).cast("string")).alias("docket_id"), F.concat(F.lit("D"), k.cast("string")).alias("document_number"), F.when(k % 2 == 0, "Rule").otherwise("Proposed Rule").alias("type"),
        action.alias("action"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size") * 7).alias("publication_date"), F.lit(100).alias("start_page"), (100 + F.col("p_size") * (1 + k % 3)).alias("end_page"),
    )


@query(
    "T20_W13_pick_rule",
    f"""with {_FR} select docket_id, document_number, pages, published from (select *, cast(end_page - start_page + 1 as bigint) as pages, cast(publication_date as varchar) as published,
  row_number() over (partition by docket_id order by action like '%correction%', action like 'Interim%', end_page - start_page desc, publication_date desc, document_number) as k from fr where type = 'Rule') where k = 1""",
)
def _(spark, d):
    return parsing.pick_document(_federal(spark, d), "Rule").select("docket_id", "document_number", F.col("pages").cast("long").alias("pages"), "published")


@query(
    "T20_pick_proposed",
    f"""with {_FR} select docket_id, document_number, published from (select *, cast(publication_date as varchar) as published,
  row_number() over (partition by docket_id order by action like '%correction%', action not like 'Supplemental%', publication_date desc, end_page - start_page desc, document_number) as k from fr where type = 'Proposed Rule') where k = 1""",
)
def _(spark, d):
    return parsing.pick_document(_federal(spark, d), "Proposed Rule").select("docket_id", "document_number", "published")


# watch

_W = """p as (select o_orderkey as k, 'O' || o_orderkey as document_number, 'ABC-2020-' || (o_custkey % 300) as docket, cast(o_orderdate as date) as published, cast(o_orderdate as date) + 60 as close from orders where o_orderkey % 29 <> 0),
f as (select 'ABC-2020-' || (o_custkey % 300) as docket, min((cast(o_orderdate as date), 'O' || o_orderkey)) as m from orders where o_orderkey % 29 = 0 group by 1),
r as (select p.docket as docket_id, p.document_number, p.published, date_diff('day', date '1998-01-01', close) as days_left, m, case when m is not null then 'analyzable' when close >= date '1998-01-01' then 'open' else 'closed' end as status from p left join f using (docket)),
best as (select * from (select *, row_number() over (partition by docket_id order by case status when 'open' then 1 when 'analyzable' then 2 else 3 end, published desc, document_number) as q from r) where q = 1)"""


def _rules(spark, d):
    o = rel.base(spark, d, "orders")
    named = o.select(
        F.col("o_orderkey").alias("k"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("document_number"),
        F.array(F.concat(F.lit("Docket ABC-2020-"), (F.col("o_custkey") % 300).cast("string"), F.lit(", x"))).alias("docket_ids"),
        F.to_date("o_orderdate").alias("publication_date"), F.date_add(F.to_date("o_orderdate"), 60).cast("string").alias("comments_close_on"),
    )
    return named.where("k % 29 <> 0"), named.where("k % 29 = 0")


@query(
    "N5_J16_W11_T25_watch",
    f"with {_W} select docket_id, document_number, cast(days_left as bigint) as days_left, status, m[2] as final_document from best".replace("m[2]", "struct_extract(m, 2)"),
)
def _(spark, d):
    proposals, finals = _rules(spark, d)
    pulled = spark.createDataFrame([("ABC-2020-1",)], "docket_id string")
    return watch.scan(proposals, finals, pulled, F.lit("1998-01-01").cast("date")).select("docket_id", "document_number", F.col("days_left").cast("long").alias("days_left"), "status", "final_document")


@query("A17_J9_watch_counts", f"with {_W} select status, count(*) as n from best group by status")
def _(spark, d):
    proposals, finals = _rules(spark, d)
    return watch.counts(watch.scan(proposals, finals, spark.createDataFrame([], "docket_id string"), F.lit("1998-01-01").cast("date")))


@query("W12_closing_soon", f"with {_W} select docket as docket_id, document_number, cast(date_diff('day', date '1998-01-01', close) as bigint) as days_left from p where date_diff('day', date '1998-01-01', close) between 0 and 30")
def _(spark, d):
    return watch.closing_soon(_rules(spark, d)[0], F.lit("1998-01-01").cast("date")).withColumn("days_left", F.col("days_left").cast("long"))


# console


@query("S15_search", "select p_partkey as docket_id, p_name as title from part where contains(lower(p_name), 'a') order by p_size desc, p_partkey limit 25")
def _(spark, d):
    part = rel.base(spark, d, "part").select(F.col("p_partkey").alias("docket_id"), F.col("p_name").alias("title"), F.col("p_size").alias("modified"))
    return console.search(part, "A").select("docket_id", "title")


@query("S16_agencies", "select distinct lower(n_name) as slug, n_name as name from nation where n_nationkey % 4 <> 0")
def _(spark, d):
    nation = rel.base(spark, d, "nation").select(F.when(F.col("n_nationkey") % 4 != 0, F.lower("n_name")).alias("slug"), F.col("n_name").alias("name"))
    return console.agencies(nation)


@query("N11_comment_detail", with_ctes(_B, "select comment_id, docket_id, coalesce((select count(*) from dedup d where d.docket_id = b.docket_id and d.campaign_id = b.campaign_id and b.campaign_id is not null having count(*) > 0), 1) as campaign_size from base b where comment_id = 2"))
def _(spark, d):
    return console.comment_detail(rel.metrics_base(spark, d), rel.dedup(spark, d), 2).select("comment_id", "docket_id", "campaign_size")


# the SQL surface


@query(
    "S1_S2_sql",
    "select n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderdate >= timestamp '1995-01-01' group by n_name",
)
def _(spark, d):
    from rostrum.catalog import Catalog

    catalog = Catalog(spark, {t: rel.base(spark, d, t) for t in ("orders", "customer", "nation")})
    return catalog.read(
        "select n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderdate >= ? group by n_name",
        ["1995-01-01 00:00:00"],
    )
