"""Filter audit, ranked search and packing against brute force: nulls, empty and long texts, ties, repeated rows, clashing names, empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rostrum.llm import filter_audit as audit
from rostrum.llm import lexical_search as search
from rostrum.llm import packing as pack
from rostrum.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHAPE = "doc_id long, text string, lang string, part string, n long, score long, term int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [(i, make(rng.choice([3, 40, 150, 230, 400])), rng.choice(["en", "de"])) for i in range(120)]
    out += [(200 + i, make(250).upper() if i % 2 else make(250) + " #", "en") for i in range(10)]
    out += [(300 + i, out[i][1], "fr" if i % 2 else None) for i in range(12)]  # copies
    out += [(400, None, "en"), (401, "", None), (402, "", ""), (403, " ,. \n", "en"), (404, make(3), "en"), (404, out[5][1], "de"), (404, out[5][1], "de")]
    out += [(None, out[7][1], "en"), (None, make(220), "en"), (405, make(30_000), "en"), (406, "A" * 9 + " b" * 300, "en")]
    return [(*r, "x", 1, 2, 3) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SHAPE).repartition(4).cache()


def test_filter_audit(spark, docs, rows):
    labels = [(r[0], i % 2, int(i % 5 == 0)) for i, r in enumerate(rows) if r[0] is not None and i % 3] + [(None, 1, 1), (5, None, None), (5, 1, 0), (9999, 1, 1)]
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(r[0], first.get(r[1] or "", r[0]))
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    fails = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        w = BLANK.findall(t)
        f = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), doc_id is not None and doc_id > first[t])
        fails.append((lang or "", {c for c, x in zip("ABCDE", f, strict=True) if x}, doc_id in good, doc_id in toxic))
    assert all(any(c in f for _, f, *_ in fails) for c in "ABCDE")
    want, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for k, c in enumerate(order, 1):
            for part in {f[0] for f in fails}:
                mine = [f for f in fails if f[0] == part]
                before, removed = [f for f in mine if not f[1] & set(order[: k - 1])], [f for f in mine if c in f[1] and not f[1] & set(order[: k - 1])]
                shapley[part, c] += len(removed)
                want[part, order, k] = [
                    len(before) - len(removed), len(removed), sum(c in f[1] for f in mine) - len(removed), sum(f[1] == {c} for f in mine), sum(f[2] for f in removed), sum(f[3] for f in removed),
                ]
    of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(docs, of).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in got} == want and len(got) == len(want)
    assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in got)
    whole = audit.filter_audit(docs, of, whole=True).where("part is null").collect()
    assert len(whole) == 600 and all(r.kept == sum(v[0] for (_, o, k), v in want.items() if (o, k) == (r.filter_order, r.step)) for r in whole)
    assert audit.filter_audit(docs.limit(0), of).count() == 0
    assert audit.filter_audit(docs, of.limit(0)).where("good_lost > 0").count() == 0


def ranked(rows, items, k=10):
    terms = lambda t: WORD.findall((t or "").translate(LOWER))
    bags = [(r[0], Counter(terms(r[1]))) for r in rows]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    by = defaultdict(set)
    for item, text in items:
        by[item] |= set(terms(text))
    out = {}
    for item, own in by.items():
        scores = []
        for d, b in bags:
            m = 100 - 90 + 90 * b.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in own if b[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out |= {(item, i): (None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize(("alpha", "item_bytes", "block"), [(0.5, 4_000_000, 16_384), (1.0, 300, 7)])
def test_lexical_search(spark, docs, rows, monkeypatch, alpha, item_bytes, block):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    rng = random.Random(3)
    items = [(i, " ".join(BLANK.findall(rows[i][1])[:30])) for i in range(12)] + [(20, rows[121][1]), (21, None), (22, "!?"), (23, "unheard of"), (None, rows[3][1]), (1, rows[2][1]), (24, "é"), (25, rows[141][1])]
    items += [(30 + i, " ".join(rng.choice(BLANK.findall(rows[-2][1])) for _ in range(20))) for i in range(6)]
    table = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    got = search.lexical_search(docs, table, alpha=alpha, item_bytes=item_bytes).collect()
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got} == ranked(rows, items) and len({(r.item_id, r["rank"]) for r in got}) == len(got)


def test_lexical_search_of_nothing_and_ties(spark, docs):
    items = spark.createDataFrame([("b", "one two"), ("a", "two")], "item_id string, text string")
    assert search.lexical_search(docs.limit(0), items).count() == search.lexical_search(docs, items.limit(0)).count() == 0
    same = spark.createDataFrame([(i % 15, "two words") for i in range(40, 0, -1)] + [(99, "other"), (None, "two words")], "doc_id long, text string")
    got = sorted((r.item_id, r["rank"], r.doc_id) for r in search.lexical_search(same, items).collect())
    want = sorted(i % 15 for i in range(1, 41))[:10]
    assert got == [(x, k, d) for x in "ab" for k, d in enumerate(want, 1)]


def test_lexical_search_needs_few_exact_scores(spark, monkeypatch):
    """The bounds leave few candidates where a few documents have all of an item's terms."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    common = [f"c{i}" for i in range(20)]
    table = [(i, " ".join(rng.choices(common, k=40) + rng.sample(vocabulary, 20))) for i in range(3000)]
    item = " ".join(common[:8] + vocabulary[:20])
    table += [(5000 + i, item + " " + " ".join(rng.choices(common, k=10 * i))) for i in range(12)]
    sizes = {}
    inner = search.cut
    monkeypatch.setattr(search, "cut", lambda df, label: sizes.setdefault(label, inner(df, label)))
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = search.lexical_search(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {(1, r["rank"]): (r.doc_id, r.score) for r in got.collect()} == ranked([(*t, None) for t in table], [(1, item)])
    assert sizes["candidates"].count() < 300


def packed(docs, **more):
    got, by = pack.packing(docs, tokenizer_path("byte_bpe_50k.json"), **more).collect(), defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    size, padding = more.get("size", 2048), 0
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return got, padding


@pytest.mark.parametrize("size", [2048, 64])
def test_packing(docs, rows, size):
    from tokenizers import Tokenizer

    use = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got, padding = packed(docs, size=size)
    assert padding <= 0.005 * sum(r.length for r in got)
    ids = [(r[0], np.array([*use.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")) for r in rows]
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids)
    left = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    cuts = defaultdict(set)
    for r in got:
        cuts[r.doc_id, r.doc_tokens].add((r.start, r.length))
    for doc_id, x in ids:  # rows of one doc_id and number of ids may be cut alike
        ends = {}
        for start, length in cuts[doc_id, len(x)]:
            if left[k := (doc_id, start, length, zlib.crc32(x[start : start + length].tobytes()), len(x))]:
                ends.setdefault(start, []).append((start + length, k))
        path, at = [], 0
        while at < len(x):
            at, k = ends[at][0]
            path.append(k)
        assert at == len(x)
        left.subtract(path)
    assert not any(left.values())


def test_packing_of_mostly_long_rests(spark):
    """Rests of more than half a window can't share one: they are cut."""
    df = spark.createDataFrame([(i, "a " * (40 + i % 9)) for i in range(200)] + [(500, None), (501, "")], "doc_id long, text string")
    got, padding = packed(df, size=64)
    assert padding <= 0.02 * sum(r.length for r in got)
    assert packed(df.limit(0))[0] == []


def test_a_very_long_text_is_packed(spark):
    text = " ".join(f"w{i % 977}" for i in range(300_000))
    got, _ = packed(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"))
    assert sum(r.length for r in got if r.doc_id == 1) == next(r.doc_tokens for r in got if r.doc_id == 1) and {r.length for r in got if r.start == 0} == {2048, 2}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abXYZ's.,;:!?() \n\t\r \u0085 é×÷ñÃ1Ω中<|endoftext>-_\x0b\x1c", max_size=50), max_size=8))
def test_chunks_have_the_tokenizers_ids(texts):
    use = pack.coder(tokenizer_path("byte_bpe_50k.json"))
    ids, each = use.encode(pa.array(texts, pa.string()), 1)
    want = [[*use.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert each.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60), st.integers(0, 6))
def test_best_fit_decreasing_takes_the_tightest_window(lengths, waste):
    windows: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = [(64 - sum(lengths[j] for j in w), w) for w in windows]
        fits = [r for r, _ in room if r >= lengths[i]]
        if fits:
            next(w for r, w in reversed(room) if r == min(fits)).append(i)
        else:
            windows.append([i])
    own = pack.best_fit_decreasing(lengths, 64)
    sums = lambda ws: sorted(sum(lengths[i] for i in w) for w in ws)
    assert sums(own) == sums(windows) and sorted(i for w in own for i in w) == list(range(len(lengths)))
    full = pack.filled([[(i, 0, lengths[i]) for i in w] for w in own], 64, waste)
    parts = defaultdict(list)
    for w in full:
        n = sum(hi - lo for _, lo, hi in w)
        assert 0 < n <= 64 and (n & (n - 1) == 0 or 64 - n <= waste)
        for i, lo, hi in w:
            parts[i].append((lo, hi))
    for i, found in parts.items():
        assert [lo for lo, _ in sorted(found)] == [0, *(hi for _, hi in sorted(found))][:-1] and max(hi for _, hi in found) == lengths[i]
