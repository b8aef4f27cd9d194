"""Every operator, and the pipeline, on texts of 300,000 words: whole results in bounded time."""

import random
from collections import Counter

import pytest

from rostrum.llm import chat_format, decontamination, filter_audit, line_dedup, mixing, ngram_jaccard, packing, quality_rules, suffix_dedup, token_output
from rostrum.llm.queries import tokenizer_path

N = 300_000


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(977)]
    free, cycle = " ".join(rng.choices(vocabulary, k=N)), " ".join(vocabulary[i % 977] for i in range(N))
    return {1: free, 2: cycle, 3: "short text", 4: f"{free} x"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "t" if i == 4 else "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").cache()


def repeated(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    return len({i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)})


def test_operators(spark, docs, texts):
    from tokenizers import Tokenizer

    size = {i: len(t.split()) for i, t in texts.items()}
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard.ngram_jaccard_join(docs).collect()}
    assert got == {1: (1, 1), 4: (1, 1), 2: (2, 0), 3: (3, 0)}
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality_rules.statistics(docs).collect()}
    assert got == {i: (size[i], repeated(t.split())) for i, t in texts.items()}
    chats = docs.selectExpr("doc_id as conv_id", "0L as turn", "'assistant' as role", "text")
    assert {r.conv_id: r.loss_chars for r in chat_format.chat_format(chats).collect()} == {i: len(t) for i, t in texts.items()}
    use = Tokenizer.from_file(tokenizer_path())
    assert {r.doc_id: r.n_tokens for r in token_output.token_output(docs, tokenizer_path()).collect()} == {i: len(use.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    pages = docs.selectExpr("doc_id as page_id", "concat('http://h/', doc_id) as url", "replace(text, 'w7 ', '<br>') as html")
    assert {r.page_id: r.n_lines for r in line_dedup.line_dedup(pages).collect()} == {i: sum(bool(x.strip()) for x in t.replace("w7 ", "\n").split("\n")) for i, t in texts.items()}
    passage = texts[1].split()[1000:1040]
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontamination.decontaminate(docs, items).collect()} == {1: 40, 4: 40, 2: 0, 3: 0}
    assert {r.doc_id: r["size"] for r in mixing.mixture(docs).collect()} == size
    gone = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs).drop("kept").collect()}
    assert gone[1] == gone[3] == 0 and gone[4] == len(texts[1]) and gone[2] == len(texts[2]) - len(" ".join(f"w{i}" for i in range(977))) - 1
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    first = {r.filter_order[0]: r.removed for r in filter_audit.filter_audit(docs, labels).where("step = 1").collect()}
    assert first == {"A": 1, "B": 3, "C": 0, "D": 0, "E": 0}
    pieces = packing.packing(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in texts} == {r.doc_id: r.doc_tokens for r in pieces}


def test_pipeline(spark, docs, texts, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {1, 2, 3} and {1, 2} & {r.doc_id for r in got} and min(r.n_tokens for r in got if r.doc_id != 3) > N
