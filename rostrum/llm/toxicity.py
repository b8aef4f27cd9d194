"""Toxicity: a counterfactual-regularised logistic classifier over the distinct words of whole texts.

Fit: a bounded sample of labelled rows (FIT_ROWS, the smallest by a seeded hash of doc_id, none of them held out) gives
the distinct words of each text. All words that differ between the labels (score test, LEAST_Z or more, in LEAST_DOCS texts or more)
and the identity terms are features, however many there are; each is a word of its own. The loss is logistic, with a ridge and a
counterfactual term: for each labelled text that names an identity term, the term is swapped for every other term of its group and
the squared change of the logit is penalised, so that naming one group instead of another doesn't move the score. Newton steps, each solved by
conjugate gradients over the texts' sparse rows, run in one task that holds the bounded sample's words only; the driver gets the
weights, at most one for each word of the sample. Texts with the same words count once. Only the text is ever an input of a score.

Scoring is one pass over all documents with the broadcast weights; words are told apart by their bytes.

Null or empty texts have no words: they get the score of the intercept. Labels that are null, or of documents that
don't exist, are ignored; of repeated labels the largest counts, of repeated doc_ids the smallest text is learned from,
and each repeated row gets its score. A null doc_id is never held out. If the labels are of one class only, or none,
the score is the smoothed share of label 1. Further columns are ignored, and those named like a result are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rostrum.llm import wordbytes as wb
from rostrum.llm.common import frugal

FIT_ROWS = 12_000
LEAST_DOCS = 4
LEAST_Z = 4.0
RIDGE = 0.15
COUNTERFACTUAL = 4.0

#: Terms of one group stand in for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "latino", "african", "european", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "queer"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("blind", "deaf", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    ("frauen", "männer", "muslime", "christen", "juden"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
)


@dataclass
class Model:
    weights: dict[str, float]
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct words, sorted, one blank between them."""
    for batch in batches:
        for part in wb.pieces(batch, "text"):
            spelled, lo, hi = wb.joined(w := wb.words(part.column("text")))
            sets = [b" ".join(sorted(set(spelled[lo[s] : hi[e - 1]].split(b" ")))) if s < e else b"" for s, e in zip(w.rows[:-1], w.rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(sets, pa.binary())], ["toxic", "words"])


def swaps(word: np.ndarray, row: np.ndarray, n: int, number: dict[str, int]) -> dict[tuple[int, int], float]:
    """How often one identity term would be swapped for another over n texts; a term's swaps weigh 1 together.

    `word`: numbers of the texts' distinct words, joined; `row`: the text of each; `number`: of the words that occur.
    """
    out: dict[tuple[int, int], float] = {}
    for group in IDENTITY_TERMS:
        ids = sorted(number[t] for t in group if t in number)
        has = np.zeros((n, len(ids)))
        for j, x in enumerate(ids):
            has[row[word == x], j] = 1
        times = has.T @ (1 - has) / max(len(group) - 1, 1)
        out |= {(ids[i], ids[j]): float(times[i, j]) for i, j in np.argwhere(times > 0)}
    return out


@dataclass
class Problem:
    """The loss over sparse rows: text row[i] holds feature at[i]; the last feature is the bias, which all texts hold.
    swapped: pairs of features and the force that holds their weights together."""

    row: np.ndarray
    at: np.ndarray
    labels: np.ndarray
    width: int
    swapped: list[tuple[int, int, float]]

    def logits(self, w: np.ndarray) -> np.ndarray:
        return np.clip(np.bincount(self.row, w[self.at], len(self.labels)), -30, 30)

    def back(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, u[self.row], self.width)

    def penalty(self, w: np.ndarray) -> np.ndarray:
        """The gradient of the ridge and the counterfactual term, half of whose product with `w` is their value."""
        out = RIDGE * w
        out[-1] = 0
        for i, j, force in self.swapped:
            d = force * (w[i] - w[j])
            out[i] += d
            out[j] -= d
        return out

    def loss(self, w: np.ndarray) -> float:
        m = self.logits(w)
        return float((np.logaddexp(0, m) - self.labels * m).sum() + w @ self.penalty(w) / 2)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        return self.back(1 / (1 + np.exp(-self.logits(w))) - self.labels) + self.penalty(w)

    def solved(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The Newton step for gradient `g` by conjugate gradients, scaled by the diagonal."""
        p = 1 / (1 + np.exp(-self.logits(w)))
        bend = p * (1 - p)
        scale = self.back(bend) + RIDGE + 1e-9
        for i, j, force in self.swapped:
            scale[i] += force
            scale[j] += force
        x, r = np.zeros_like(g), g.copy()
        z = r / scale
        d, rz, enough = z, r @ z, 1e-8 * np.linalg.norm(g)
        for _ in range(500):
            if np.linalg.norm(r) <= enough:
                break
            h = self.back(bend * np.bincount(self.row, d[self.at], len(bend))) + self.penalty(d) + 1e-9 * d
            step = rz / (d @ h)
            x, r = x + step * d, r - step * h
            z = r / scale
            d, rz = z + (r @ z) / rz * d, r @ z
        return x


def fit(texts: list[list[str]], labels: np.ndarray, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Screened by the score test, then Newton steps; `texts`: each text's distinct words."""
    n = len(labels)
    share = (labels.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    if n == 0 or labels.min() == labels.max():
        return Model({}, bias)
    coded = pa.array([w for t in texts for w in t], pa.string()).dictionary_encode()
    words, word = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    row = np.repeat(np.arange(n), [len(t) for t in texts])
    often = np.bincount(word, minlength=len(words))
    above = np.bincount(word, (labels - share)[row], len(words))
    z = above / np.sqrt(share * (1 - share) * np.maximum(often * (1 - often / (n + 1)), 1e-9))
    pairs = swaps(word, row, n, {w: i for i, w in enumerate(words)})
    used = np.union1d(np.flatnonzero((np.abs(z) >= LEAST_Z) & (often >= LEAST_DOCS)), np.array([x for p in pairs for x in p], np.int64)).astype(np.int64)
    place = np.full(len(words), -1)
    place[used] = np.arange(len(used))
    at = place[word]
    keep = at >= 0
    swapped = [(int(place[a]), int(place[b]), 2 * counterfactual * count) for (a, b), count in pairs.items()]
    problem = Problem(np.append(row[keep], np.arange(n)), np.append(at[keep], np.full(n, len(used))), labels, len(used) + 1, swapped)
    w = np.zeros(len(used) + 1)
    w[-1] = bias
    loss = problem.loss(w)
    for _ in range(60):
        g = problem.gradient(w)
        step = problem.solved(w, g)
        size = 1.0
        while (now := problem.loss(w - size * step)) > loss and size > 1e-6:
            size /= 2
        if now > loss:
            break
        w, gain, loss = w - size * step, loss - now, now
        if gain < 1e-9 * n:
            break
    return Model({words[i]: float(x) for i, x in zip(used, w[:-1], strict=True)}, float(w[-1]))


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most `rows` labelled documents that aren't held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _fitted(counterfactual: float):
    """The fit as one task: rows of word and weight, the bias as the null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int]] = []
        for b in batches:
            rows += zip(b.column("words").to_pylist(), b.column("toxic").to_pylist(), strict=True)
        rows.sort()  # sums don't depend on the order in which rows come
        model = fit([x.decode().split(" ") if x else [] for x, _ in rows], np.array([float(t > 0) for _, t in rows]), counterfactual)
        yield pa.RecordBatch.from_arrays([pa.array([*model.weights, None], pa.string()), pa.array([*model.weights.values(), model.bias])], ["word", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Fitted in one task over at most `rows` rows; the driver gets the weights."""
    found = sample(docs, labels, rows).select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(frugal(_word_sets), "toxic int, words binary")
    # texts with the same words count once
    found = found.groupBy(F.sha2("words", 256).alias("key")).agg(F.first("words").alias("words"), F.max("toxic").alias("toxic")).select("words", "toxic").repartition(1)
    weights = {r["word"]: r["weight"] for r in found.mapInArrow(frugal(_fitted(counterfactual)), "word string, weight double").collect()}
    return Model(weights, weights.pop(None, 0.0))


def _score(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        known = pa.array([w.encode() for w in model.weights], pa.large_binary())
        weight = np.array([*model.weights.values(), 0.0])
        for batch in batches:
            for part in wb.pieces(batch, "text"):
                _, row, word, _ = wb.known_words(part.column("text"), known)
                logit = np.bincount(row, weight[word], part.num_rows) + model.bias
                score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names), pa.array(score)], [*part.schema.names, name])

    return run


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The columns of `docs` (text among them) and the score as column `name`; a column of that name is replaced."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(frugal(_score(shared, name)), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
