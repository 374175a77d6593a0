"""A corpus pipeline: quality, near-duplicates, leaks, secrets, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the mix adds mix_shard, mix_copy and mix_place.

For all stages: null texts count as empty, null ids and sources are carried, very long texts are read whole, extra columns
are kept whatever their names, and an empty table gives an empty result. Each stage says what becomes of ties and repeated rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from pixelframe.llm import ledger, mixing, pu, simhash, tiling
from pixelframe.llm.common import finished, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those that score under its threshold; equal texts are decided alike, repeated rows stay each."""
    return pu.accepted(docs, pu.train(pu.features(docs), read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity 0.8. It is that of the least id
    (null last, then by a hash of the text); of equal rows one stays, and of all texts without words one."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; documents without words hold none. Repeated rows are decided alike."""
    return tiling.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts, and n_chars counted anew; all rows stay. Null texts stay null."""
    return ledger.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents are repeated or left out so that the sources have their target weights.

    Documents without words go along with their block; rows that repeat an id are taken alike; ties of size go by the hash."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing to target weights", mixing_stage),
]

#: SQL can't express the stages; they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = finished(partial(stage, spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
