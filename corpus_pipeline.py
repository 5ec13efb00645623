"""A corpus pipeline over the training-data operators.

Each stage takes the whole table its predecessor kept.  Between stages the rows
are written as Parquet to the shared folder and read back, so a lost executor
costs a stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladeframe.functions.storage import discard, materialize, scratch
from cladeframe.llm.decontamination import decontaminate
from cladeframe.llm.mixing import Mixture
from cladeframe.llm.near_dedup import keep_one
from cladeframe.llm.quality import keep_good
from cladeframe.llm.secret_scan import redact


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the certified cutoffs reject go.

    Null and empty texts fail the base rules; null ids and languages are rows and
    a stratum like others; repeated rows are judged alike; an empty table stays empty.
    """
    return keep_good(docs, _read(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, Jaccard 0.8 or more) the document of least id stays.

    Candidates come from the grid over SimHash fingerprints, an exact test
    follows, and an exact search finds the near pairs that differ in more bits.
    Wordless texts, null ones among them, are one group; a null id is the
    largest; of repeated rows one stays; an empty table stays empty.
    """
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts hold none; repeated rows go or stay together; an empty
    table stays empty, and with an empty benchmark all stay.
    """
    return decontaminate(docs, _read(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind in brackets.

    Every row stays, null texts as they are, repeated ones alike; an empty table stays empty.
    """
    return redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture takes, repeats counted.

    Null texts have no words and 0 are taken; null sources are one source; repeated
    rows have a place each; an empty table gives an empty one.
    """
    return Mixture(docs).taken()


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
]

#: Components of near duplicates, certified cutoffs and alignments are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage writes for itself is deleted after it."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", stays=True)
        discard(before)
    return docs
