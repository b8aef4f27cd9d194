import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from rostrum.functions import grams
from rostrum.operators import campaigns
from rostrum.plans import registry


def test_hashes_are_those_of_plain_tokens():
    rng = random.Random(1)
    texts = ["", "a", "a b", " a b c d e ", "a b c d e f a b c d e", "éa", "", "supercalifragilisticexpialidocious x"]
    texts += ["".join(rng.choice("ab c'9.é¢ \n") for _ in range(rng.randint(0, 80))) for _ in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "lower_text"])
    for part in (batch, batch.slice(5, 100), batch.slice(0, 1), batch.slice(0, 0)):
        tokens = [re.findall("[a-z0-9']+", texts[i]) for i in part.column("id").to_pylist()]
        got = next(grams.hashed_texts(iter([part]))).column("exact_hash").to_pylist()
        assert got == [hashlib.sha256(" ".join(t).encode()).hexdigest()[:16] for t in tokens]
        want = [{" ".join(t)} if 0 < len(t) < 5 else {" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in tokens]
        found = next(grams.hashed_shingles(5)(iter([part]))).column("s").to_pylist()
        assert [len(set(s)) for s in found] == [len(s) for s in found] == [len(w) for w in want]
        assert len(set().union(*found)) == len(set().union(*want))


def test_campaigns_move_neither_texts_nor_shingles_of_one_text(spark, sf, monkeypatch):
    written = []

    def cut(df, label):
        out = real(df, label)
        written.append(out)
        return out

    real = campaigns.cut
    monkeypatch.setattr(campaigns, "cut", cut)
    assert registry.QUERIES["W4_T6_A15_dedup_table"](spark, sf).count() == 200
    assert written and not any("full_text" in df.columns for df in written)
    sets = [df.select("docket_id", F.explode("s").alias("s")) for df in written if "s" in df.columns]
    assert sets and all(df.groupBy("docket_id", "s").count().where("count = 1").count() == 0 for df in sets)


def test_campaigns_count_shingles_by_parts_and_verify_few_candidates(spark, monkeypatch):
    """Texts put together from passages of eight others share rare shingles with each, and are near none."""
    rng = random.Random(3)
    plain = [[f"w{i}x{j}" for j in range(100)] for i in range(40)]
    mixed = [[w for i in range(8 * k, 8 * k + 8) for w in plain[i][20:50]] for k in range(1, 4)]
    near = [[*plain[i][:97], "other", "words", "here"] for i in range(4)]
    rows = [("d", f"c{i:03}", " ".join(t)) for i, t in enumerate(plain + mixed + near)]
    rng.shuffle(rows)
    verified, labels = [], []
    real, cut = campaigns.linked, campaigns.cut

    def linked(left, right, verify, *more):
        def counted(pairs):
            verified.append(pairs.count())
            return verify(pairs)

        return real(left, right, counted, *more)

    def written(df, label):
        out = cut(df, label)
        labels.append((label, out.count()))
        return out

    monkeypatch.setattr(campaigns, "linked", linked)
    monkeypatch.setattr(campaigns, "cut", written)
    got = campaigns.connected(spark.createDataFrame(rows, "docket_id string, rep_id string, full_text string")).collect()
    assert {(r.rep_id, r.root) for r in got} == {x for i in range(4) for x in ((f"c{i:03}", f"c{i:03}"), (f"c{43 + i:03}", f"c{i:03}"))}
    # a mixed text has most of its shingles from others, but is longer than each: it is in none, and none of them is mostly in it
    assert verified[1] == 0
    shared = [n for label, n in labels if label == "shared"]
    assert len(shared) == campaigns.SHINGLE_PARTS and max(shared) < 0.5 * sum(shared)
