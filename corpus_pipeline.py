"""A training corpus from raw documents: quality filter, near duplicates, repeated passages, source mix, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import arborplan
from arborplan.llm import mixing, ngram_join, packing, quality, suffix_dedup
from arborplan.llm.common import cut, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Near duplicates: words of a shingle, and the least similarity in per cent.
SHINGLE = 5
PERCENT = 80
#: Repeated passages: bytes of the shortest one that goes. A passage of 51 words, the shortest that counts as one, has 251 bytes
#: or more in 99 of 100 places of the tables; with the 400 bytes of op3 most of such passages would stay.
PASSAGE = suffix_dedup.PASSAGE
PASSAGE_GRAM = suffix_dedup.PASSAGE_GRAM


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network scores 0.5 or more; it learns from the rows of labels, without the held-out ones.

    Null and empty texts have the score of a text without bytes and go or stay alike. Repeated rows and ties get equal scores. Very long texts are scored whole, in
    parts. Columns of any names stay as they are. An empty table gives no rows.
    """
    arborplan.ship(spark)
    net = quality.learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept(docs, net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a chain of links joins: the one with the smallest doc_id. Two link when they share 80 % of their shingles of five words.

    Null and empty texts are no group and stay; repeated rows are one. A null doc_id stays only in a group without any other. Very
    long texts are read whole. Columns of any names stay as they are. An empty table gives no rows.
    """
    arborplan.ship(spark)
    return ngram_join.keep_one(docs, SHINGLE, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated strings of PASSAGE bytes cover (whole characters only); documents of which nothing is left go.

    Null, empty and short texts stay as they are. Repeated rows of PASSAGE bytes or more go as a whole; the stage before leaves none. Very long texts
    are worked on in parts. Columns of any names stay; n_chars follows the text. An empty table gives no rows.
    """
    arborplan.ship(spark)
    return suffix_dedup.without_repeats(docs, PASSAGE, PASSAGE_GRAM)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and once more with a part of its words if it takes a part.

    Null and empty texts have no words, so they go. Null is a source of its own. Repeated rows are documents of their own and keep their own values. Ties in a shard
    are told apart by id, text and then all other columns. Columns of any names stay; n_chars follows the text. An empty table gives no rows.
    """
    arborplan.ship(spark)
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document's ids, a sequence each, with the ids themselves.

    A null or empty text is its end id alone. Repeated rows are documents of their own. Very long texts have as many pieces as they need. Columns beside
    doc_id and text aren't read, so any names will do. An empty table gives no rows.
    """
    arborplan.ship(spark)
    return packing.pack(docs, packing.tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("packing", packed),
]

#: The classifier and the tokenizer can't be said in SQL; stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what each returns is written in the shared folder and read again. What the stages stored goes when the last has ended; its result stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for _, stage in STAGES[:-1]:
            with scratch(spark):
                docs = cut(stage(spark, docs, sf_dir), keep=True)
        return cut(STAGES[-1][1](spark, docs, sf_dir), keep=True)
