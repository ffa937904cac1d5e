"""A pipeline over documents: quality, near duplicates, benchmark leaks, mixture, token store.

Every stage takes all that its predecessor kept, as written and read again, and all but the last return the columns of documents.

quality keeps a row whose text scores QUALITY or more; near_dedup one document of each group of near duplicates, that of the smallest doc_id;
decontaminate rows whose text holds no benchmark item; mix the documents that fill 0.9 of the tokens by weight; tokens one row for each document stored.

Nulls and odd rows: a null text is an empty one: it is scored like others, has no near duplicate, holds no item, has no tokens and so ends at
mix. A row with a null doc_id is judged by its text, and is no one's near duplicate. Rows that repeat a doc_id are scored, searched and mixed each by its own text; near_dedup
keeps all of them or none. Exact copies tie: the smallest doc_id stays. Texts of any length are read whole. More columns, whatever
their names (score, gone, leak_ and the like), pass through unchanged up to the last stage. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontamination, minhash_dedup, mixing, quality_mil, token_store
from tidewright.llm.common import fresh, materialize, table
from tidewright.llm.queries import MIX_WEIGHTS, mix_leaves

QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, name = quality_mil.fit(docs, table(spark, sf_dir, "labels")), fresh("score", docs.columns)
    return quality_mil.score(docs, model, name).where(F.col(name) >= QUALITY).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mix_leaves(), budget=0.9, weights=MIX_WEIGHTS, most_epochs=1, seed=42)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.store_and_verify(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Neither the classifier nor the tokenizer can be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
