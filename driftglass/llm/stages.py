"""The pipeline's stages: ``(spark, docs, sf_dir) -> DataFrame``; all but the last keep the columns of ``documents``.

In every stage: other columns stay as they are, whatever their names; an empty table gives an empty one; texts are read
whole. The quality stage drops null and blank texts, which have fewer words than its base rules ask for. In the stages
after it a null text counts as an empty one: near-dedup keeps one of them, passages and mixing leave it, packing gives
it its end id. Rows with a null id are rows like others: near-dedup keeps one only where no row of its group has an id.
Rows that repeat an id are judged each by its text; near-dedup keeps one of rows that repeat id and text. Ties - equal
texts, equal positions of equal rows - go to the smallest id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import mixing, packing, passages, quality_llr, similar
from .common import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the n-gram ratio reject."""
    judged = quality_llr.judge(docs, read_table(spark, sf_dir, "labels"))
    return judged.where("quality.kept").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of similar texts: the smallest id's, one without an id only where none has one.

    SimHash links come first and are verified; a prefix filter adds the pairs beyond the fingerprints' radius."""
    return similar.one_of_each(docs, shingle=5, similarity=0.8)


#: Bytes of the shortest passage taken out: below fifty words of ordinary prose.
PASSAGE = 250


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that occur more than once out of the texts."""
    return passages.without_passages(docs, length=PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Orders the documents so that sources come in proportion to the square roots of their sizes."""
    return mixing.in_order(docs)


#: Words a worker remembers while it packs: idle workers count beside the stages that need none.
REMEMBERED = 40_000


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of at most 4096 tokens, in the order of the mix: a table that was written and read
    again comes in the order of its files' sizes, so the positions are worked out again. A pool of one block moves no
    document by more than that."""
    return packing.pack_texts(mixing.in_order(docs), public_tokenizers.path("word_bpe_49k.json"), end_id=2, pool=32, remembered=REMEMBERED).withColumnRenamed("id", "doc_id")
