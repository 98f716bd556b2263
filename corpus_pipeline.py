"""From documents to packed training sequences: each stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import mixing, neardup, packing, toxicity
from pagewright.llm.common import free_name, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels of sf_dir, scores below its threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity")
    return toxicity.score(docs, model, score_column=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: that with the smallest doc_id."""
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: some not at all, some up to three times."""
    return mixing.apply_mix(docs, mixing.entropy_balance(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full training sequences, with their ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: A learnt model, MinHash and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of sf_dir, each result written and read again."""
    df = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        df = stored(stage(spark, df, sf_dir), name)
    return STAGES[-1][1](spark, df, sf_dir)
