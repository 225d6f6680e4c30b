"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that its predecessor kept and takes and returns the columns of
``documents``; the last one returns the pieces of the packed sequences.

1. toxicity: documents scored 0.7 or more go;
2. simhash: of each near-duplicate class the document with the smallest id stays;
3. substrings: words of 13-word windows that an earlier document has are cut out;
4. pii: personal data gets format-preserving pseudonyms;
5. packing: what is left becomes sequences of 2048 ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queryloom.llm import packing, pii, simhash_dedup, substring_dedup, toxicity
from queryloom.llm._common import checkpoint_folder, remove_folder, ship, table
from queryloom.llm.queries import tokenizer_path


def _as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; n_chars follows the text."""
    return df.select(*(F.length("text").cast(like.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in like.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model, name = toxicity.train(docs, table(spark, sf_dir, "labels")), "_toxicity"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return toxicity.apply(docs, model, score_col=name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash_dedup.keep_one(docs)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _as_documents(substring_dedup.remove_repeated(docs), docs)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _as_documents(pii.pseudonymize(docs, pii.key_of(spark)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.digest(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_spans),
    ("pii", pseudonymize),
    ("packing", pack),
]
ORACLE_SQL = None  # no stage can be said in SQL; tests/llm compares the pipeline with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between two is a Parquet table in the shared checkpoint folder."""
    docs, folder, last = table(spark, sf_dir, "documents"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove_folder(spark, last)
            last = path
    return docs
