"""Reduction and clusters against plain versions: numpy's SVD, HDBSCAN and average linkage written down by their definitions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.operators import linkage, semantic
from rostrum.plans import registry


def clouds(seed, sizes, width=6, spread=0.15):
    """Unit vectors around random centers, and as many far from all."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centers = rng.standard_normal((len(sizes), width))
    rows = np.concatenate([c + spread * (1 + i) * rng.standard_normal((n, width)) for i, (c, n) in enumerate(zip(centers, sizes, strict=True))] + [rng.standard_normal((sum(sizes) // 5, width))])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def frame(spark, dockets):
    rows = [(d, f"{d}{i:04}", v.tolist()) for d, x in dockets.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "docket_id string, id string, vector array<double>").repartition(3).cache()


def same_sets(got, want):
    """Labels may be numbered otherwise; -1 is -1."""
    assert [g == -1 for g in got] == [w == -1 for w in want]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def by_docket(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.id):
        out.setdefault(r.docket_id, []).append(r.cluster_id)
    return out


@pytest.mark.parametrize("block_rows", [16_384, 12])
def test_reduction_has_the_cosines_of_the_exact_svd(spark, monkeypatch, block_rows):
    monkeypatch.setattr(semantic, "RANGE", 64)
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(150)]
    texts = [(d, f"{d}{i:03}", " ".join(rng.choices(vocabulary[i % 5 * 30 : i % 5 * 30 + 12], k=40))) for d, n in (("a", 60), ("b", 25 if block_rows > 25 else 9), ("c", 2), ("d", 1), ("e", 7)) for i in range(n)]
    df = spark.createDataFrame(texts + [("a", "none", ""), ("f", "f0", None)], "docket_id string, id string, text string")
    weights = linkage.tfidf(df).cache()
    cells = {}
    for r in weights.collect():
        cells.setdefault(r.docket_id, {}).setdefault(r.id, {})[r.term] = r.w
    for dimensions in (256, 5):
        got = {(r.docket_id, r.id): np.array(r.vector) for r in semantic.reduced(weights, dimensions, block_rows).collect()}
        assert set(got) == {(d, i) for d, of in cells.items() for i in of}
        for d, of in cells.items():
            ids, terms = sorted(of), sorted({t for x in of.values() for t in x})
            x = np.array([[of[i].get(t, 0.0) for t in terms] for i in ids])
            k = min(dimensions, max(2, len(terms) - 1), len(ids) - 1) if len(ids) > 2 else 2
            u, s, _ = np.linalg.svd(x, full_matrices=False)
            want = u[:, :k] * s[:k]
            want = want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
            mine = np.array([got[d, i] for i in ids])
            assert mine.shape[1] == min(k, len(terms)) and np.abs(mine @ mine.T - want @ want.T).max() < (1e-4 if dimensions == 256 else 2e-2), d


def plain_hdbscan(x, least=3):
    """Labels by the definition: the whole distance matrix, Kruskal's tree, sets of points for clusters."""
    n = len(x)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    core = np.sort(d, axis=1)[:, least - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    edges = sorted((reach[i, j], i, j) for i, j in itertools.combinations(range(n), 2))
    set_of, tree = {i: frozenset([i]) for i in range(n)}, {}
    for w, i, j in edges:
        a, b = set_of[i], set_of[j]
        if a != b:
            tree[a | b] = (w, a, b)
            for p in a | b:
                set_of[p] = a | b

    def walk(points, born):
        """(stability of the best choice below, its clusters, own stability) of the cluster that begins with `points`."""
        own, now = 0.0, points
        while True:
            if len(now) < least:
                return own, [points], own
            w, a, b = tree[now]
            lam = 1 / w
            big = [s for s in (a, b) if len(s) >= least]
            if len(big) == 2:
                own += (lam - born) * len(now)
                parts = [walk(s, lam) for s in (a, b)]
                deeper = sum(p[0] for p in parts)
                return (deeper, [c for p in parts for c in p[1]], own) if deeper > own else (own, [points], own)
            own += (lam - born) * (len(now) - sum(map(len, big)))
            if not big:
                return own, [points], own
            now = big[0]

    whole, now = frozenset(range(n)), frozenset(range(n))
    while True:  # the root is never a cluster itself
        w, a, b = tree[now]
        big = [s for s in (a, b) if len(s) >= least]
        if len(big) != 1:
            break
        now = big[0]
    labels = [-1] * n
    if len(big) == 2:
        for k, c in enumerate(c for s in big for c in walk(s, 1 / w)[1]):
            for p in c:
                labels[p] = k
    assert whole
    return labels


@pytest.mark.parametrize("rows", [2_048, 40])
def test_density_clusters(spark, rows):
    dockets = {"a": clouds(1, [60, 40, 30, 25]), "b": clouds(2, [20, 20, 8]), "c": clouds(3, [4, 3]), "d": clouds(4, [3, 1]), "e": clouds(5, [90], spread=0.4)}
    got = by_docket(semantic.density_clusters(frame(spark, dockets), rows=rows).collect())
    for d, x in dockets.items():
        want = plain_hdbscan(x) if len(x) >= 6 else [-1] * len(x)
        same_sets(got[d], want)
    assert len(set(got["a"])) > 3 and set(got["d"]) == {-1}


def test_density_clusters_of_equal_units(spark):
    x = clouds(9, [30, 20])
    x = np.concatenate([x, np.repeat(x[:1], 7, axis=0), np.repeat(x[40:41], 4, axis=0)])
    got = by_docket(semantic.density_clusters(frame(spark, {"a": x}), rows=16).collect())["a"]
    assert len({got[0], *got[60:67]}) == 1 and got[0] >= 0 and len({got[40], *got[67:]}) == 1
    assert semantic.density_clusters(frame(spark, {"a": x}).limit(0)).count() == 0


def plain_average(x, below):
    sets = [[i] for i in range(len(x))]
    d = np.round(1 - x @ x.T, 12)
    while len(sets) > 1:
        best = min((float(d[np.ix_(a, b)].mean()), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2))
        if best[0] >= below:
            break
        sets[best[1]] += sets.pop(best[2])
    labels = [0] * len(x)
    for k, s in enumerate(sets):
        for p in s:
            labels[p] = k
    return labels


@pytest.mark.parametrize("rows", [2_048, 16])
def test_average_linkage(spark, rows):
    dockets = {"a": clouds(11, [30, 20, 15]), "b": clouds(12, [10, 10], spread=0.5), "c": clouds(13, [1])}
    got = by_docket(semantic.average_linkage(frame(spark, dockets), rows=rows).collect())
    for d, x in dockets.items():
        same_sets(got[d], plain_average(x, 0.35))
    assert semantic.average_linkage(frame(spark, dockets).limit(0)).count() == 0


@pytest.mark.parametrize("within", [16_384, 5])
def test_average_linkage_of_large_parts(spark, within):
    """Parts within a task and by rounds; equal units, units of length 0, which are near nothing, and single ones as well."""
    a = clouds(21, [25, 20], spread=0.25)
    dockets = {"a": np.concatenate([a, np.repeat(a[:1], 9, axis=0), np.repeat(a[30:31], 3, axis=0)]), "b": np.zeros((8, 6)), "c": clouds(22, [12, 9]), "d": np.repeat(a[2:3], 11, axis=0)}
    got = by_docket(semantic.average_linkage(frame(spark, dockets), rows=8, within=within).collect())
    for d, x in dockets.items():
        same_sets(got[d], plain_average(x, 0.35))
    assert len(set(got["b"])) == 8 and set(got["d"]) == {0} and 1 < len(set(got["a"])) < 50


def test_average_linkage_writes_as_often_for_large_groups(spark, monkeypatch):
    """A group of near copies takes one after the other in; that was a round, and five written tables, for each."""
    written, write = [], semantic.cut
    monkeypatch.setattr(semantic, "cut", lambda df, label: written.append(label) or write(df, label))
    rng = np.random.Generator(np.random.PCG64(31))
    center, took = np.eye(24)[0], {}
    for n in (4, 40):
        x = center + 0.01 * rng.standard_normal((n, 24))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        written.clear()
        got = by_docket(semantic.average_linkage(frame(spark, {"a": x})).collect())["a"]
        same_sets(got, plain_average(x, 0.35))
        took[n] = len(written)
    assert took[40] <= took[4]


def test_connected_is_the_components_of_near_pairs():
    x = clouds(33, [20, 15, 10], width=5, spread=0.3)
    near = 1 - x @ x.T < 0.2
    want = np.arange(len(x))
    for _ in x:
        want = np.array([want[near[i]].min() for i in range(len(x))])
    for cut_at in (0, 17):
        p = {"block_a": 0, "block_b": 1 if cut_at else 0, "n_a": cut_at or len(x), "n_b": len(x) - cut_at, "v_a": x[: cut_at or len(x)].ravel(), "v_b": x[cut_at:].ravel()}
        node, other = semantic._connected(0.2)(p)
        place = lambda n: (n >> 32) * cut_at + (n & 0xFFFFFFFF)
        got = np.arange(len(x))
        got[place(node)] = place(other)
        if not cut_at:
            assert got.tolist() == want.tolist()
        # pairs of one side are told by that side's own pair of blocks
        assert all(want[i] == want[got[i]] for i in range(len(x))) and all(got[i] == got[j] for i in range(cut_at) for j in range(cut_at, len(x)) if near[i, j])


def test_clusters_have_a_medoid_each(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(90)]
    texts = [(d, f"{d}{i:03}", " ".join(rng.choices(vocabulary[i % 3 * 30 : i % 3 * 30 + 14], k=20))) for d, n in (("a", 40), ("b", 24), ("c", 4)) for i in range(n)]
    df = spark.createDataFrame([*texts, ("a", "empty", None)], "docket_id string, id string, text string")
    weights = linkage.tfidf(df).cache()
    vectors = {(r.docket_id, r.id): np.array(r.vector) for r in semantic.reduced(weights).collect()}
    for method in (semantic.density_clusters, semantic.average_linkage):
        got = linkage.clusters(weights, df.select("docket_id", "id"), method).collect()
        assert len(got) == len(texts) + 1 and next(r for r in got if r.id == "empty").cluster_id == -1
        for d, c in {(r.docket_id, r.cluster_id) for r in got if r.cluster_id >= 0}:
            mine = [r for r in got if (r.docket_id, r.cluster_id) == (d, c)]
            mean = np.mean([vectors[d, r.id] for r in mine], axis=0)
            best = [r.id for r in mine if r.is_medoid]
            assert len(best) == 1 and vectors[d, best[0]] @ mean >= max(vectors[d, r.id] @ mean for r in mine) - 1e-6
    assert {r.docket_id for r in linkage.clusters(weights, df.select("docket_id", "id")).where(F.col("is_medoid")).collect()} >= {"a", "b"}


def test_reduction_writes_a_row_for_a_text_and_none_for_a_term(spark, sf, monkeypatch):
    written = []
    for module in (linkage, semantic, registry):
        monkeypatch.setattr(module, "cut", lambda df, label, real=module.cut: written.append(real(df, label)) or written[-1])
    got = registry.QUERIES["M1_reduced_vectors"](spark, sf)
    assert got.count() and not any({"id", "term"} <= set(df.columns) for df in written)


@pytest.mark.parametrize("keys", [linkage.KEYS, 1])
def test_rows_of_terms_are_those_of_tfidf(spark, monkeypatch, keys):
    monkeypatch.setattr(linkage, "VOCABULARY", 30)
    monkeypatch.setattr(linkage, "KEYS", keys)
    rng = random.Random(8)
    # few words often, many seldom: the border has ties, and one docket has no word that often
    texts = [(d, f"{d}{i:02}", " ".join(rng.choices([f"word{int(40 * rng.random() ** 3)}" for _ in range(9)], k=12))) for d in "ab" for i in range(20)]
    df = spark.createDataFrame([*texts, ("a", "a98", None), ("c", "c0", " ".join(f"once{i}" for i in range(50)))], "docket_id string, id string, text string")
    pairs = linkage.tfidf(df).collect()
    want, terms = {}, {}
    for r in sorted(pairs, key=lambda r: r.term):
        no = terms.setdefault(r.docket_id, {}).setdefault(r.term, len(terms.get(r.docket_id, ())))
        want.setdefault((r.docket_id, r.id), []).append((no, r.w))
    got = {(r.docket_id, r.id): list(zip(r.terms, r.weights, strict=True)) for r in linkage.tfidf_rows(df).collect()}
    assert set(got) == set(want) and {d for d, _ in got} == {"a", "b"}
    assert all([n for n, _ in got[k]] == [n for n, _ in want[k]] and np.allclose([w for _, w in got[k]], [w for _, w in want[k]]) for k in got)


def test_density_clusters_by_parts_of_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(semantic, "COPIES", 2)
    dockets = {"a": clouds(1, [60, 40, 30, 25]), "c": clouds(3, [4, 3])}
    df = frame(spark, dockets)
    blocks = semantic.packed(df, 20)
    parts = semantic.pair_parts(blocks)
    copies = [semantic._pairs(blocks, i, parts).select("docket_id", "block_a", "block_b").collect() for i in range(parts)]
    n = blocks.where("docket_id = 'a'").count()
    assert parts >= 4 and max(map(len, copies)) < sum(map(len, copies)) / 2
    assert sorted((r.block_a, r.block_b) for c in copies for r in c if r.docket_id == "a") == [(i, j) for i in range(n) for j in range(i, n)]
    got = by_docket(semantic.density_clusters(df, rows=20).collect())
    for d, x in dockets.items():
        same_sets(got[d], plain_hdbscan(x))
