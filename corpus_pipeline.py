"""The corpus pipeline: quality rules, line dedup, near dedup, mixing and packing of `documents`."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from skyquilt.llm import linededup, mixing, neardup, packing, quality
from skyquilt.llm.common import cut
from skyquilt.llm.queries import tokenizer_file
from skyquilt.ship import ship


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let Spark drop the shuffle files of what is checkpointed or counted inside as soon as that is done.

    A stage takes dozens of shuffles, each of which leaves files for every pair of tasks; once a
    result is in the checkpoint folder nothing reads them again, and what is lost is computed anew.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines.

    Null and empty texts go; equal rows are judged alike and all stay; ids may be null or
    repeated; columns keep their values whatever their names; an empty table stays empty.
    """
    ship(spark)
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; what is left empty goes.

    Null ids come first in the order of copies; rows with the same id and text are one
    document here and all stay; null texts stay null; an empty table stays empty.
    """
    ship(spark)
    with brief_shuffles(spark):
        return linededup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Of rows with the same id and text one stays; other texts under the same id are
    documents of their own; null ids and texts without words stay; an empty table stays empty.
    """
    ship(spark)
    with brief_shuffles(spark):
        return neardup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in training order.

    Texts without words are never taken; a null source is one of its own; rows that share
    an id are documents of their own; an empty table stays empty.
    """
    with brief_shuffles(spark):
        return mixing.training_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences, with their token ids, in windows of the training order.

    The order is that of the table's files and rows. A null text is its end id alone; rows that share an
    id, as turns of one document do, are documents of their own; an empty table stays empty.
    """
    ship(spark)
    with brief_shuffles(spark):
        return packing.pack(docs, tokenizer_file(), window=packing.WINDOW, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Tokenizing has no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage returns is written once, as the next one reads it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
