"""Quality rules: fixed base rules and a learned decision list, all in DataFrame expressions.

`statistics` counts each whole text within its row, without exploding or shuffling it. Words in repeated 3-word windows are found by
sorting one long for each window: the window's hash above, its position below. Neighbours with equal hash bits are
compared word by word, so the counts are exact.

`learn` is sequential covering over labelled rows (quality 0 or 1) that pass the base rules: two thirds grow a rule,
condition by condition with the best information gain over quantile thresholds, one third prunes its tail and judges it.
Each step is one grouped count over binned features, whose result has features x bins rows however many labels there are.
A rule that doesn't hold where it is judged makes way for the next best start; the list ends when no start is left, or at
the limits, which are parameters. The rules become one ordered CASE expression.

Null or empty texts have no words and fail the base rules. Labels that are null, or of documents that don't exist, are
ignored, of repeated labels the smallest counts; without enough labels, or with those of one class, the list is empty and
keeps everything. Each repeated row gets its own result.
Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import cut

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3

LEAST_WORDS = 50
MOST_REPEATED = 50



@dataclass(frozen=True)
class Limits:
    """How far a list is learned; none of them depends on the number of rows."""

    bins: int = 48  # quantile thresholds of a feature, at most
    rules: int = 12
    conditions: int = 3
    grown: int = 4  # bad rows that a condition must keep while a rule grows
    judged: int = 2  # rows that a rule must reject among those that judge it
    precision: float = 0.9  # and the share of bad ones among them


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _shift(name: str, value: Column, bits: Column) -> Column:
    return F.call_function(name, value, bits)


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three words that occur twice or more."""

    def start(x: Column, mask: Column) -> Column:
        return x.bitwiseAND(mask).cast("int")

    def with_bits(bits: Column) -> Column:
        mask = _shift("shiftleft", F.lit(1).cast("long"), bits) - 1
        top = lambda x: _shift("shiftright", x, bits)
        code = lambda i: _shift("shiftleft", _shift("shiftright", F.xxhash64(words[i], words[i + 1], words[i + 2]), bits), bits).bitwiseOR(i.cast("long"))
        packed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), code))

        def same(x: Column, y: Column) -> Column:
            return _let(start(x, mask), lambda a: _let(start(y, mask), lambda b: (words[a] == words[b]) & (words[a + 1] == words[b + 1]) & (words[a + 2] == words[b + 2])))

        def near(s: Column, j: Column, test: Callable[[Column, Column], Column]) -> Column:
            x = s[j]
            return ((j > 0) & test(x, s[F.greatest(j - 1, F.lit(0))])) | ((j < F.size(s) - 1) & test(x, s[F.least(j + 1, F.size(s) - 1)]))

        def covered(found: Column) -> Column:
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
            return F.aggregate(F.sort_array(F.transform(found, lambda x: start(x, mask))), zero, step, lambda a: a["n"])

        def exact(c: Column) -> Column:
            mixed = F.exists(F.sequence(F.lit(1), F.size(c) - 1), lambda j: (top(c[j]) == top(c[j - 1])) & ~same(c[j], c[j - 1]))
            plain = F.filter(c, lambda x, j: near(c, j, same))
            # other windows share the hash bits, which hardly ever happens: compare all candidates
            slow = F.filter(c, lambda x: F.exists(c, lambda y: (x != y) & (top(x) == top(y)) & same(x, y)))
            return F.when(F.size(c) < 2, F.lit(0).cast("long")).otherwise(covered(F.when(mixed, slow).otherwise(plain)))

        equal = lambda x, y: top(x) == top(y)
        return _let(packed, lambda s: _let(F.filter(s, lambda x, j: near(s, j, equal)), exact))

    bits = F.ceil(F.log2(F.size(words).cast("double") + 1)).cast("int")
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(_let(bits, with_bits))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text of `docs` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text")).withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclaim"),
    ).select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words", F.col("lines.n").alias("n_lines"), "n_upper", "n_exclaim")


def features() -> dict[str, Column]:
    per = lambda a, b: 100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
        "symbols": per("n_symbols", "word_chars"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeated": per("n_repeat_words", "n_words"),
        "upper": per("n_upper", "word_chars"),
        "exclaim": per("n_exclaim", "n_words"),
        "line_words": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # >= threshold, else <
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.threshold if self.above else value < self.threshold


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    if p <= 0 or p0 <= 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def learn(stats: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> list[list[Condition]]:
    """Ordered rules, each a conjunction that rejects; rows that fail the base rules take no part, their fate is settled."""
    usable = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    grow = F.crc32(F.concat(F.lit("p"), F.col("doc_id").cast("string")).cast("binary")) % 3 != 0
    rows = stats.where(~base_failed()).join(usable, "doc_id").select((F.col("quality") == 0).cast("int").alias("bad"), grow.alias("grow"), *(v.alias(k) for k, v in features().items()))
    rows = cut(rows, "labelled")
    names = list(features())
    asked = rows.agg(*(F.percentile_approx(k, [i / limits.bins for i in range(1, limits.bins)], 2000).alias(k) for k in names)).first()
    edges = {k: sorted(set(asked[k] or [])) for k in names}
    if not any(edges.values()):
        return []

    def bin_of(name: str) -> Column:
        if not edges[name]:
            return F.lit(0)
        value = F.col(name)
        return F.size(F.filter(F.array(*(F.lit(float(t)) for t in edges[name])), lambda t: t <= value))

    binned = cut(rows.select("bad", "grow", F.array(*map(bin_of, names)).alias("bins")), "binned")

    def holds(rule: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for f, above, b in rule:
            out = out & ((F.col("bins")[f] >= b) if above else (F.col("bins")[f] < b))
        return out

    Literal = tuple[float, tuple[int, bool, int], tuple[int, int]]

    def literals(left: DataFrame, grown: list[list[tuple[int, bool, int]]]) -> list[list[Literal]]:
        """For each of some conjunctions the conditions that could follow, by falling gain, and the (bad, all) rows that each would
        reject where it is judged; one grouped count for all of them."""
        which = F.array_compact(F.array(*(F.when(holds(rule), i) for i, rule in enumerate(grown))))
        cells_of = left.select("grow", "bad", "bins", F.explode(which).alias("c")).select("c", "grow", "bad", F.posexplode("bins").alias("f", "b"))
        cells = np.zeros((len(grown), len(names), max(map(len, edges.values())) + 1, 2, 2), np.int64)
        for r in cells_of.groupBy("c", "grow", "f", "b").agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("n")).collect():
            cells[r["c"], r["f"], r["b"], int(r["grow"])] = r["p"], r["n"]
        return [follow(c) for c in cells]

    def follow(cells: np.ndarray) -> list[Literal]:
        found = []
        for f, name in enumerate(names):
            below = np.concatenate([np.zeros((1, 2, 2), np.int64), np.cumsum(cells[f], axis=0)])
            p0, all0 = below[-1, 1].tolist()
            for b in range(1, len(edges[name]) + 1) if all0 > p0 else ():
                for above, side in ((True, below[-1] - below[b]), (False, below[b])):
                    p, n = side[1].tolist()
                    if p >= limits.grown and (g := _gain(p0, all0 - p0, p, n - p)) > 1e-9:
                        found.append((g, (f, above, b), tuple(side[0].tolist())))
        return sorted(found, key=lambda x: (-x[0], x[1]))

    rules: list[list[tuple[int, bool, int]]] = []
    while len(rules) < limits.rules:
        left = binned
        for r in rules:
            left = left.where(~holds(r))
        # the best start of each feature and direction; all grow at once, and the first that holds where it is judged becomes the rule
        starts: dict[tuple[int, bool], tuple[list, list]] = {}
        for _, first, judged in literals(left, [[]])[0]:
            starts.setdefault(first[:2], ([first], [judged]))
        grows = list(starts.values())
        for _ in range(limits.conditions - 1):
            if not grows:
                break
            more = literals(left, [grown for grown, _ in grows])
            for (grown, worth), found in zip(grows, more, strict=True):
                if found:
                    grown.append(found[0][1])
                    worth.append(found[0][2])
            grows = [g for g, found in zip(grows, more, strict=True) if found]
        for grown, worth in starts.values():
            # pruned to its best head
            fit = [k for k, (p, n) in enumerate(worth) if n >= limits.judged and p >= limits.precision * n]
            if fit:
                rules.append(grown[: max(fit, key=lambda k: (2 * worth[k][0] - worth[k][1], -k)) + 1])
                break
        else:
            break
    return [[Condition(names[f], above, float(edges[names[f]][b - 1])) for f, above, b in rule] for rule in rules]


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that rejects, from 1, or 0."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_rules(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and rule (0: none rejects)."""
    stats = cut(statistics(docs), "statistics")
    return judge(stats, learn(stats, labels, limits))


def judge(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """The verdict of the base rules and a learned list on `statistics`."""
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
    )
