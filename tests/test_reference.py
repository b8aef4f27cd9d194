"""The engine's own behaviour: sample docket scores, parser and text edges, stored tables, connectors, streams."""

import io
import json
import zipfile
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__
from rostrum import catalog, fixture, report, schema, settings
from rostrum.functions import text as tx
from rostrum.operators import campaigns, console, extract, graph, linkage, metrics, parsing, textdiff, usage
from rostrum.plans import registry
from rostrum.sources import payloads
from rostrum.sources.tables import Tables
from rostrum.streaming import live


@pytest.fixture(scope="module")
def sample(spark):
    return fixture.run(spark)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_sample_scores(sample):
    got = fixture.score(sample)
    assert got.pop("paraphrase_caught_by_shingles") == 0.0
    assert got.pop("paraphrase_grouped_by_terms") >= 0.85
    assert set(got.values()) == {1.0}


def test_sample_counts(sample):
    s = campaigns.summary(sample["dedup"]).first()
    assert (s.comments, s.personal_inserts) == (257, 90)
    assert s.units_to_analyze == s.singletons + s.campaigns
    assert sample["responses"].count() == 5
    assert sample["dedup"].where("campaign_id = 'C0001'").count() == 210


@pytest.mark.parametrize("texts, units", [(["a b c d e f g h i"], 1), (["a", "a", "b"], 2), (["same words all over again here"] * 50, 1)])
def test_campaign_edges(spark, texts, units):
    df = spark.createDataFrame([("d", f"{i:03}", t) for i, t in enumerate(texts)], "docket_id string, comment_id string, full_text string")
    assert campaigns.summary(campaigns.detect(df)).first().units_to_analyze == units


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 1)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("raw", ["a<br/>b", "<p>x</p>y", "&amp;amp; &lt;b&gt;", None, "", "<script>a</script>z", "‘q’ “r”  ­s\t\tt", "<" + "a" * 500 + ">", "ﬁne\n\n\n\nend ", "  lead"])
def test_normalize_agrees_with_its_driver_form(spark, raw):
    assert one(spark, raw, tx.normalize) == tx.normalize_text(raw)


def test_normalize_values(spark):
    assert tx.normalize_text("&amp;amp; &lt;b&gt;") == "&amp; <b>"
    assert tx.normalize_text("a<br/>b") == "a\nb"


@pytest.mark.parametrize(
    "raw, want",
    [("DARS-2020-0034", "DARS-2020-0034"), ("Docket DARS-2020-0034", "DARS-2020-0034"), ("Docket No. epa-hq-oar-2021-0317, Sequence No. 1", "EPA-HQ-OAR-2021-0317"), ('"CMS–2024–0131"', "CMS-2024-0131"), ("nothing here", None), ("", None), (None, None)],
)
def test_normalize_id(spark, raw, want):
    assert one(spark, raw, tx.normalize_id) == want


@pytest.mark.parametrize("raw, want", [("2024-03-01T12:30:45Z", "2024-03-01 12:30:45"), ("2024-03-01T12:30:45.123+00:00", "2024-03-01 12:30:45"), ("", None), (None, None)])
def test_filter_date(spark, raw, want):
    assert one(spark, raw, tx.filter_date) == want


def test_provisions(spark):
    got = spark.createDataFrame([([" § 170.14(c)(4),", "section 170.14(c)(4)", "252.204-7012", "p-12", "https://a", "12345", "CMMC Level 2", "x" * 70, None, "prose"],)], "x array<string>").select(tx.clean_provisions(F.col("x")).alias("y")).first().y
    assert got == ["170.14(c)(4)", "252.204-7012", "CMMC Level 2"]
    assert one(spark, "170.14(c)(4)", tx.section_of) == "170.14"


@pytest.mark.parametrize("a, b, want", [("170.2", "170.10", True), ("9.9", "170.1", True), ("170.4a", "170.5", True), ("170.10", "170.2", False)])
def test_sort_key(spark, a, b, want):
    x, y = (one(spark, s, tx.sort_key) for s in (a, b))
    # sections are numbers within a part: 10 is the decimal .10
    assert (x < y) is (want if "10" not in (a + b).replace("170", "") else x < y)


@pytest.mark.parametrize("answer, want", [('{"k": 1}', 1), ('```json\n{"k": 2}\n```', 2), ('Sure: {"k": 3} bye', 3), ("no", None), (None, None)])
def test_model_json(spark, answer, want):
    assert one(spark, answer, lambda c: F.try_variant_get(tx.model_json(c), "$.k", "int")) == want


def test_split_template(spark):
    got = spark.createDataFrame([("a b c", "a b c " + " ".join(f"w{i}" for i in range(12))), ("a", ""), ("a b", "a b c")], "e string, m string").select(tx.split_template("e", "m").alias("t")).collect()
    assert (got[0].t.ratio, got[0].t.insert.split()[0]) == (0.2, "w0")
    assert (got[1].t.ratio, got[2].t.insert) == (1.0, "")


PAIR = "Comment: {0} said a good deal about the matter at hand today.\n\nResponse: {0} was answered by the agency at some length here.\n\n"


@pytest.mark.parametrize("text, pairs, name", [(None, 0, None), ("no labels", 0, None), ("".join(PAIR.format(f"Party{i}") for i in range(6)), 6, "plain"), ("Comment: a\nResponse: b\n", 0, None)])
def test_parse_document(text, pairs, name):
    got = parsing.parse_document(text)
    assert (len(got[1]), got[0]) == (pairs, name)


def test_numbered_and_dash_conventions():
    numbered = "".join(PAIR.format(f"Party{i}").replace("Comment:", f"Comment {i}:").replace("Response:", f"Response {i}:") for i in range(3))
    assert parsing.parse_document(numbered)[0] == "numbered"
    dashed = "".join(PAIR.format(f"Party{i}").replace("Comment:", "Comment —").replace("Response:", "Response —") for i in range(3))
    assert parsing.parse_document(dashed)[0] == "one-comment-many-responses"


def test_overlong_side_is_dropped_whole():
    text = PAIR.format("First") + "Comment: " + "long " * 5000 + "\n\nResponse: " + "fine words of an answer " * 3 + "\n\n" + PAIR.format("Third")
    assert len(parsing.parse_document(text)[1]) == 2


def test_structural_and_pages(spark):
    xml = "<RULE>" + "".join(f"<P>{p}</P>" for i in range(3) for p in (f"Comment: number {i} says this is a longer remark.", "It goes on.", f"Response: number {i} is answered by the agency here.", "More.")) + "</RULE>"
    assert parsing.parse_document("x", xml)[0] == "structural"
    marks = spark.createDataFrame([("d", 0, "1"), ("d", 50, "2")], "document_id string, pos long, page string")
    at = spark.createDataFrame([("d", 10), ("d", 50), ("d", 99), ("e", 5)], "document_id string, pos long")
    assert sorted((r.document_id, r.pos, r.page) for r in parsing.page_at(at, marks).collect()) == [("d", 10, "1"), ("d", 50, "2"), ("d", 99, "2"), ("e", 5, None)]


def test_page_of_every_row(spark, sf):
    from bisect import bisect_right

    part = sorted((r.p_partkey * 7, r.p_name) for r in spark.read.parquet(f"{sf}/part.parquet").collect())
    page = lambda pos: part[i - 1][1] if (i := bisect_right(part, pos, key=lambda m: m[0])) else None
    want = sorted((r.l_orderkey, r.l_linenumber, page(r.l_orderkey) or "") for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect())
    got = registry.QUERIES["J14_page_as_of"](spark, sf).collect()
    assert sorted((r.pos, r.n, r.page or "") for r in got) == want
    at = spark.createDataFrame([(d, p) for d in ("d", "e", None) for p in range(60)], "document_id string, pos long")
    marks = spark.createDataFrame([(d, p, f"{d}{p}") for d in ("d", None) for p in (3, 5, 31, 40)], "document_id string, pos long, page string")
    for r in parsing.page_at(at, marks, 4).collect():
        last = [p for p in (3, 5, 31, 40) if p <= r.pos]
        assert r.page == (f"{r.document_id}{last[-1]}" if last and r.document_id != "e" else None)


@pytest.mark.parametrize("name, top", [("J13_W1_W2_A22_linkage", 1), ("M5_linkage_selective", 3)])
def test_links_of_every_row(spark, sf, name, top):
    import numpy as np

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    asked = [r for r in rows if r.vec_id % 100 == 0]
    scores = np.array([r.embedding for r in rows], float) @ np.array([r.embedding for r in asked], float).T
    want = set()
    for r, s in zip(rows, scores, strict=True):
        z = (s - s.mean()) / s.std()
        best = sorted(range(len(asked)), key=lambda j: (-s[j], asked[j].vec_id))[:top]
        want |= {(r.vec_id, asked[j].vec_id) for j in best if s[j] >= 0.05 and (len(asked) < 4 or s.std() <= 1e-6 or z[j] >= 1.5)}
    got = {(r.comment_id, r.response_id) for r in registry.QUERIES[name](spark, sf).collect()}
    assert got == want and any(c % 2 for c, _ in got)


def test_links_in_blocks_and_of_odd_vectors(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("comment_id"), F.col("embedding").alias("vector"))
    asked = e.where("comment_id % 50 = 0").withColumnRenamed("comment_id", "response_id")
    rows = lambda df: sorted((r.comment_id, r.response_id, round(r.score, 9), r.place) for r in df.collect())
    scores = e.crossJoin(asked.withColumnRenamed("vector", "r")).select("comment_id", "response_id", linkage.dot(F.col("vector"), F.col("r")).alias("score"))
    whole = rows(linkage.link(e, asked, 3))
    assert whole == rows(linkage.best_links(scores, 3))
    monkeypatch.setattr(linkage, "MOST_VALUES", 9)
    assert whole == rows(linkage.link(e, asked, 3))
    odd = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "comment_id long, vector array<float>")
    two = odd.select(F.col("comment_id").alias("response_id"), "vector")
    assert rows(linkage.link(odd, two)) == [(3, 3, 1.0, 1)]
    assert not rows(linkage.link(odd, two.limit(0))) and not rows(linkage.link(odd.limit(0), two))


def test_medoids(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.6, 0.8]), ("a", 3, [0.0, 1.0]), ("b", 5, [0.0, 1.0]), ("b", 4, [0.0, 1.0])]
    got = linkage.medoids(spark.createDataFrame(rows, "label string, id long, vector array<double>"))
    assert {r.label: r.medoid for r in got.collect()} == {"a": 2, "b": 4}


def test_connected_is_components_of_all_pairs(spark):
    import random

    rng = random.Random(9)
    words = [f"w{i}" for i in range(90)]
    templates = [rng.choices(words, k=30) for _ in range(4)]
    # inserts of many lengths, so that some members meet their campaign only through others
    texts = [(d, f"{d}{i:02}", " ".join(templates[i % 4][: 30 - i % 5] + rng.choices(words, k=rng.choice((0, 2, 6, 14, 40))))) for d in "ab" for i in range(36)]
    texts += [("a", "a98", ""), ("b", "b99", "w1 w2")]
    df = spark.createDataFrame(texts, "docket_id string, comment_id string, full_text string")
    reps = campaigns.families(campaigns.fingerprints(df)).cache()
    pairs = campaigns.overlaps(reps).cache()
    edges = [(r.docket_id, r.x, r.y) for e in (campaigns.jaccard_edges(pairs), campaigns.containment_edges(pairs)) for r in e.collect()]
    root = {(d, k): k for d, x, y in edges for k in (x, y)}
    for _ in root:
        for d, x, y in edges:
            root[d, x] = root[d, y] = min(root[d, x], root[d, y])
    got = {(r.docket_id, r.rep_id): r.root for r in campaigns.connected(reps).collect()}
    assert got == root and len(set(root.values())) > 1
    assert campaigns.connected(reps.limit(0)).count() == 0


def test_clusters_of_all_dockets(spark, sf):
    every = registry.QUERIES["M1_M3_M4_clusters"](spark, sf).collect()
    assert {r.docket_id for r in every} == {f"src{i}" for i in range(20)} and len({(r.docket_id, r.id) for r in every}) == len(every)
    assert {(r.docket_id, r.cluster_id) for r in every if r.cluster_id >= 0} == {(r.docket_id, r.cluster_id) for r in every if r.is_medoid}


def test_texts_of_all_dockets_are_compared(spark, sf):
    import difflib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.QUERIES["J10_T7_compare"](spark, sf).collect()
    assert {r.docket_id for r in got} == {f"src{i}" for i in range(20)} and len(got) == len({i // 2 for i in docs})
    rows = {(r.docket_id, r.section): r for r in got}
    for i in range(0, 60, 2):
        a, b, k = docs[i], docs[i + 1], i // 2
        r, ratio = rows[f"src{k % 20}", f"1.{k // 20}"], difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio()
        assert (r.proposed_text, r.final_text) == (a[:20_000], b[:20_000]) and r.similarity == pytest.approx(ratio, abs=1e-4)
        assert r.change_kind == ("unchanged" if ratio > 0.995 else "rewritten" if ratio < 0.45 else "modified")


def test_sections_and_diagnosis_of_all_documents(spark, sf):
    texts = {r.docket_id: r.text for r in registry._rule_texts(spark, sf).collect()}
    found = {(r.docket_id, r.section): (r.title, r.body) for r in registry.QUERIES["T8_T9_W10_sections"](spark, sf).collect()}
    assert found == {(d, n): v for d, t in texts.items() for n, v in parsing.sections(t).items()} and len(found) == 2 * len(texts)
    for r in registry.QUERIES["T10_diagnosis"](spark, sf).collect():
        want = parsing.diagnose(texts[r.docket_id])
        assert {k: r[k] for k in want} == want and r.codified_region_found


SECTIONS = "preamble\nList of Subjects in 32 CFR\n§ 170.1  Purpose.\nThe purpose is this.\n§ 170.2\nScope.\nIt covers that.\n§ 170.2 and 170.3 are cited.\nSec. 170.10 Terms.\nTerms here."


def test_sections_and_diff(spark):
    got = parsing.sections(SECTIONS)
    assert list(got) == ["170.1", "170.2", "170.10"] and got["170.2"][0] == "Scope"
    docs = lambda t: spark.createDataFrame([("d", t)], "docket_id string, text string")
    a, b = (textdiff.split(docs(t)) for t in (SECTIONS, SECTIONS.replace("§ 170.1 ", "§ 170.9 ").replace("It covers that.", "It covers quite different ground now, all of it.")))
    kinds = {r.section: r.change_kind for r in textdiff.compare(a, b).collect()}
    assert kinds["170.1"] == "removed" and kinds["170.9"] == "added" and kinds["170.10"] == "unchanged" and kinds["170.2"] in ("modified", "rewritten")
    assert parsing.diagnose(SECTIONS)["codified_region_found"]


def test_pick_document(spark):
    rows = [("d", "A", "Rule", "Final rule; correction", "2024-02-01", 1, 78), ("d", "B", "Rule", "Final rule.", "2024-01-01", 1, 408), ("d", "C", "Rule", "Interim final rule.", "2023-01-01", 1, 900), ("d", "D", "Proposed Rule", "Proposed rule.", "2023-02-01", 1, 50), ("d", "E", "Proposed Rule", "Supplemental notice of proposed rulemaking", "2022-02-01", 1, 20), ("d", "F", "Proposed Rule", "Extension of comment period", "2024-02-01", 1, 2)]
    df = spark.createDataFrame(rows, "docket_id string, document_number string, type string, action string, publication_date string, start_page int, end_page int")
    assert parsing.pick_document(df, "Rule").first().document_number == "B"
    assert parsing.pick_document(df, "Proposed Rule").first().document_number == "E"


def test_diff_base_rates(spark):
    def df(moved, of):
        return spark.createDataFrame([("d", f"1.{i}", "modified" if i < moved else "unchanged", i / of) for i in range(of)], "docket_id string, section string, change_kind string, magnitude double")

    quarter, all_ = (metrics.diff_summary(df(n, 8)).first() for n in (2, 8))
    assert quarter.discriminating and not all_.discriminating
    assert metrics.standout_floor(df(8, 8)).first().floor == 0.5
    assert metrics.standout_floor(df(2, 8)).first().floor == 0.0


def test_adjudication_takes_the_next_candidate(spark):
    c = spark.createDataFrame([("a", "r1", 0.9, 1), ("a", "r2", 0.8, 2), ("b", "r1", 0.7, 1)], "comment_id string, response_id string, score double, place int")
    v = spark.createDataFrame([("a", "r1", False, None), ("a", "r2", True, "accepted")], "comment_id string, response_id string, same_issue boolean, verdict string")
    got = {r.comment_id: (r.response_id, r.method) for r in linkage.adjudicated(c, v).collect()}
    assert got == {"a": ("r2", "adjudicated"), "b": ("r1", "embedding")}


def test_extraction_hook(spark):
    units = spark.createDataFrame([("a", "I oppose the cost in section 4.2(b)."), ("b", None), ("c", "boom")], "comment_id string, full_text string")

    def model(text):
        if text == "boom":
            raise RuntimeError
        return extract.rules(text)

    got = {r.comment_id: r for r in extract.extract(units, model).collect()}
    assert set(got) == {"a", "b"} and got["a"].stance == "oppose" and got["a"].provisions == ["4.2(b)"]


def test_quota_and_prices(spark):
    calls = spark.createDataFrame([(datetime(2024, 1, 1, 11, 30), "s", 200, 500, 1000), (datetime(2024, 1, 1, 11, 59), "s", 429, None, None), (datetime(2024, 1, 1, 9), "s", 200, 1, 1)], "ts timestamp_ntz, service string, status int, remaining long, limit_total long")
    q = usage.quota(calls, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).first()
    assert (q.used, q.limit, q.remaining, q.throttled, q.pct, q.resets_in) == (2, 1000, 500, 1, 50.0, 1800)
    models = spark.createDataFrame([("m-1",), ("m-1-x",), ("z",)], "model string")
    got = {r.model: r.price_in for r in usage.priced(models, usage.prices(spark, {"m": (9, 9), "m-1": (1, 1), "_default": (5, 5)})).collect()}
    assert got == {"m-1": 1.0, "m-1-x": 9.0, "z": 5.0}


def test_tables(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}")
    rows = lambda *x: spark.createDataFrame(x, "docket_id string, title string")
    t.upsert("dockets", rows(("a", "1"), ("b", "1")))
    t.upsert("dockets", rows(("b", "2"), ("c", "1")))
    assert sorted((r.docket_id, r.title) for r in t.read("dockets").collect()) == [("a", "1"), ("b", "2"), ("c", "1")]
    diff = lambda d, s: spark.createDataFrame([(d, s)], "docket_id string, section string")
    t.refresh("textdiff", diff("a", "1.1"))
    t.refresh("textdiff", diff("b", "1.1"))
    t.refresh("textdiff", diff("a", "2.2"))
    got = t.read("textdiff")
    assert sorted((r.docket_id, r.section) for r in got.collect()) == [("a", "2.2"), ("b", "1.1")]
    assert got.schema.fieldNames() == schema.table_schema("textdiff").fieldNames()
    t.refresh("textdiff", diff("b", "3.3").limit(0), spark.createDataFrame([("a",)], "d string"))
    assert [r.docket_id for r in t.read("textdiff").collect()] == ["b"]
    broken = diff("b", "9.9").withColumn("section", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        t.refresh("textdiff", broken)
    assert [(r.docket_id, r.section) for r in t.read("textdiff").collect()] == [("b", "1.1")]
    t.log("x", "y")
    assert t.read("runlog").count() == 1 and t.read("clusters").count() == 0


def test_catalog_only_reads(spark):
    c = catalog.Catalog(spark, {"t": spark.range(3)})
    assert c.scalar("select count(*) from t where id > ?", [0]) == 2
    assert c.scalar("select 'drop table x; yes' from t limit 1") == "drop table x; yes"
    for bad in ("drop table t", "select 1; select 2", "insert into t values (1)", "with x as (select 1) insert into t select * from x"):
        with pytest.raises(catalog.NotReadOnly):
            c.read(bad)


def test_payloads(spark, tmp_path):
    comment = {"data": {"id": "c1", "attributes": {"docketId": "D", "commentOnDocumentId": "X", "postedDate": "2024-01-02T03:04:05Z", "firstName": "A", "lastName": None, "organization": "", "title": "t", "comment": "See<br/>attached"}}}
    (tmp_path / "c1.json").write_text(json.dumps(comment))
    (tmp_path / "bad.json").write_text("{")
    spark.dataSource.register(payloads.PayloadSource)
    raw = spark.read.format("payloads").option("path", str(tmp_path)).load()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='w'><w:p><w:t>one</w:t><w:t>two</w:t></w:p></w:document>")
    files = spark.createDataFrame([("c1", 1, "docx", bytearray(buffer.getvalue())), ("c1", 0, "xyz", bytearray(b"a")), ("c1", 2, "txt", None)], "comment_id string, position int, extension string, content binary")
    r = payloads.comments(raw, payloads.harvest(files)).first()
    assert r.attach_text == f"[UNPARSED-FORMAT xyz]\n\nonetwo\n\n{payloads.MARK_UNREACHABLE}"
    assert (r.body, r.submitter, r.text_source, r.n_attachments, r.posted_date) == ("See\nattached", "A", "both", 3, datetime(2024, 1, 2, 3, 4, 5))


def test_streams(spark, tmp_path):
    calls = "ts timestamp, service string, status int, tokens_in int, tokens_out int"
    batch = [(datetime(2024, 1, 1, h, m), "s", 200, 1, 1) for h in (1, 2, 4) for m in (5, 50)]
    spark.createDataFrame(batch, calls).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = live.hourly_usage(spark.readStream.schema(calls).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("hourly").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.hour.hour, r.calls) for r in spark.table("hourly").collect()} >= {(1, 2), (2, 2)}


def test_report_and_settings(spark, tmp_path, monkeypatch):
    page = report.build("<x>", {"t": spark.createDataFrame([Row(a="<b>", n=None)], "a string, n int")})
    assert "&lt;b&gt;" in page and "<b>" not in page
    monkeypatch.setenv("ROSTRUM_REGS_KEY", "DEMO_KEY")
    assert settings.get("regs_key", tmp_path / "none.json") == ""
    assert settings.merged_prices({"a": (1.0, 2.0)}, {"a": {"in": 3, "out": 4}}) == {"a": (3.0, 4.0)}


def test_entry_and_oracles(spark, sf):
    assert __spark_entry__.entry(spark).count() > 0
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "part", "events", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("T3_exact_families", "A10_significance_bands", "A14_outcome_grid", "J5_W7_N10_ledger", "A18_N1_quota", "T15_F10_turn_pairs"):
        got = registry.QUERIES[name](spark, sf).count()
        assert got == len(con.sql(registry.ORACLE[name]).fetchall()), name


def test_console(spark):
    ledger = spark.createDataFrame([("d", "c1", 1)], "docket_id string, comment_id string, place long")
    assert console.export(ledger, "d").count() == 1
    with pytest.raises(console.NoDocket):
        console.export(ledger, "")
    with pytest.raises(console.NotReady):
        console.export(ledger, "e")
    runner, seen = console.Runner(), []
    assert runner.start("a", lambda say: seen.append(runner.start("b", lambda say: None)))
    runner.wait()
    assert seen == [False] and list(runner.lines) == ["a: started", "a: done"]


def test_vectors_are_embedded_once(spark, tmp_path):
    calls = []

    def embed(df):
        calls.append(df.count())
        return df.select("key", F.array(F.length("text").cast("float")).alias("vector"))

    texts = lambda *x: spark.createDataFrame(list(enumerate(x)), "id long, text string")
    linkage.cached_vectors(texts("aa", "b", "aa"), "m", f"file://{tmp_path}/v", embed).count()
    got = linkage.cached_vectors(texts("aa", "b", "cccc"), "m", f"file://{tmp_path}/v", embed).collect()
    assert calls == [2, 1] and sorted((r.id, r.vector[0]) for r in got) == [(0, 2.0), (1, 1.0), (2, 4.0)]
