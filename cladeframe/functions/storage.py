"""Cutting lineage with tables in the folder that all executors share.

The cluster names that folder in ``spark.checkpoint.dir``.  Only with a local
master (tests, a laptop) is a folder of our own used where the setting is
absent; elsewhere that is an error, as each executor would write to its own disk.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(spark, "_cladeframe_dir", None):
        spark._cladeframe_dir = "file://" + tempfile.mkdtemp(prefix="cladeframe-")
    return spark._cladeframe_dir


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside, but for those told to stay, are deleted at the end."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def materialize(df: DataFrame, name: str, stays: bool = False, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result survives the loss of any executor, has no lineage, and its size
    is known to the planner.  Its path is kept in ``_cladeframe_path`` for
    :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cladeframe/{name}-{uuid.uuid4().hex}"
    if _scratch and not stays:
        _scratch[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cladeframe_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote; the DataFrame can't be read after that."""
    path = getattr(df, "_cladeframe_path", None)
    if path:
        _delete(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def dealt_into(spark: SparkSession, n: int) -> Iterator[None]:
    """Exchanges of tables that are written inside have ``n`` partitions, or the session's number if that is more.

    So what one task holds doesn't grow with the input; small partitions are put together as they are read.
    """
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(int(own), n)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)


#: Plan nodes that neither shuffle nor compute much.
_NARROW = frozenset(("Project", "Filter", "Relation", "LocalRelation"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is read in fewer partitions than there are.

    For narrow stages over one small file.  A table of many files stays where it
    is, without a shuffle, and so does the output of a shuffle.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+|-]*(\w+)", line))}
    if not nodes <= _NARROW:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
