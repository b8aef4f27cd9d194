"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
Decisions travel with their rows, or are joined back by the text's key, so repeated doc_ids don't meet each other.

In every stage null texts are empty texts, null doc_ids, langs and sources are values like others, texts are taken whole however
long, further columns stay with their rows whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import toxicity as tox
from rostrum.llm.common import cut, shared_dir, table
from rostrum.llm.decontamination import with_contamination
from rostrum.llm.mixing import mix
from rostrum.llm.ngram_jaccard import keep_one
from rostrum.llm.queries import tokenizer_path
from rostrum.llm.token_output import token_output


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.

    Texts without words have the score of the intercept. Repeated rows are scored, and go or stay, alike.
    """
    columns = docs.columns
    scored = tox.score(docs, tox.train(docs, table(spark, sf_dir, "labels")), "toxicity_score")
    return scored.where("toxicity_score < 0.5").select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Texts without words are linked to none and all stay. Of repeated rows of that doc_id and text one stays, whichever it is; a null
    doc_id stays only in a group without others.
    """
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which 5 % of the words or more lie in benchmark passages go.

    Texts without words stay, and so does everything if the benchmark has no words. Repeated rows go or stay alike.
    """
    columns = docs.columns
    return with_contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it.

    Texts without words have size 0 and aren't taken. Equal sizes are told apart by a seeded hash of doc_id and text; repeated rows are
    rows each. A null source is a source of its own, the last.
    """
    return mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, which stay in the shared folder, and for each row what is read back from them.

    Texts without tokens are the end id alone. Null doc_ids come first; rows of equal doc_id come in order of a hash of their texts, repeated
    rows one after the other.
    """
    return token_output(docs, tokenizer_path(), path=f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: SQL has no tokenizer, and the classifier is learned: the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
