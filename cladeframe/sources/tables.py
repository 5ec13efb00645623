"""Hits and trees from other programs, and the tables between steps."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe import schemas


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated hits (query, target, qstart, qend, sstart, cigar), plain or gzip, with their order."""
    raw = spark.read.csv(path, sep="\t", schema="query bigint, target bigint, qstart int, qend int, sstart int, cigar string")
    # hits are sent with their file's number by name, not the name
    name = F.col("_metadata.file_path").alias("path")
    names = sorted(r.path for r in spark.read.format("binaryFile").load(path).select(name).collect())
    files = spark.createDataFrame(list(enumerate(names)), "file int, path string")
    row = raw.select("*", name, F.monotonically_increasing_id().alias("row"))
    w = Window.partitionBy("query", "target").orderBy("file", "row")
    return row.join(F.broadcast(files), "path", "left").drop("path").withColumn("ord", F.row_number().over(w)).drop("file", "row")


def read_trees(spark: SparkSession, path: str, max_problems: int = 100) -> DataFrame:
    """(query, newick) from lines of ``query<TAB>newick``.

    Lines starting with ``Ign`` or ``WARNING`` are notes; others without a tree are
    problems, of which more than ``max_problems`` raise.
    """
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("Ign")) & ~F.startswith("value", F.lit("WARNING")))
    parts = lines.select(F.split("value", "\t", 2).alias("p"))
    trees = parts.select(F.expr("try_cast(p[0] AS bigint)").alias("query"), F.try_element_at("p", F.lit(2)).alias("newick"))
    good = F.coalesce(F.startswith("newick", F.lit("(")), F.lit(False))
    problems = trees.where(~good).limit(max_problems + 1).count()
    if problems > max_problems:
        raise ValueError(f"more than {max_problems} lines without a tree")
    return trees.where(good)


POINTER = "_current"


def _file(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """Renames a file onto another, which is replaced in one step."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = _file(spark, new)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    files.rename(fs.makeQualified(_file(spark, old)[1]), fs.makeQualified(target), options)


def current_path(spark: SparkSession, base: str, step: int, name: str) -> str:
    """The folder of a step's complete table as it is now; raises if there is none.

    A reader keeps to the version it was given, whatever is saved meanwhile.
    """
    folder = f"{base}/dir_step{step}/{name}"
    fs, pointer = _file(spark, f"{folder}/{POINTER}")
    if fs.exists(pointer):
        stream = fs.open(pointer)
        try:
            return f"{folder}/{spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
        finally:
            stream.close()
    fs, done = _file(spark, f"{folder}/_SUCCESS")  # a table that another program wrote
    if not fs.exists(done):
        raise FileNotFoundError(f"step {step} has no complete table {name} in {base}")
    return folder


def load(spark: SparkSession, base: str, step: int, name: str, schema: str | None = None) -> DataFrame:
    """A step's table; raises if the step has not completed it."""
    df = spark.read.parquet(current_path(spark, base, step, name))
    if schema is not None:
        want = [f.split()[0] for f in schema.split(", ")]
        if [c for c in want if c not in df.columns]:
            raise ValueError(f"{name} lacks columns of {want}")
    return df


def save(df: DataFrame, base: str, step: int, name: str, keep: int = 2) -> DataFrame:
    """Write a step's table as a new version, make it the current one, and read it back.

    The version's folder is written whole before a pointer file is replaced by
    one rename, so a run that fails has left the earlier table as it was, and a
    reader sees one version or the other.  Of older versions ``keep`` - 1 stay, for
    readers that began before.
    """
    spark = df.sparkSession
    folder = f"{base}/dir_step{step}/{name}"
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{folder}/{version}")
    note = f"{folder}/{POINTER}-{version}"
    fs, p = _file(spark, note)
    stream = fs.create(p)
    stream.write(bytearray(version.encode()))
    stream.close()
    _rename(spark, note, f"{folder}/{POINTER}")
    older = sorted(f.getPath().getName() for f in fs.listStatus(_file(spark, folder)[1]) if f.isDirectory() and f.getPath().getName() < version)
    for old in older[: max(0, len(older) - keep + 1)]:
        if old.startswith("v"):
            fs.delete(_file(spark, f"{folder}/{old}")[1], True)
    return spark.read.parquet(f"{folder}/{version}")


def save_text(df: DataFrame, base: str, step: int, name: str, header: bool = True) -> None:
    """Write a report as tab-separated text, beside an earlier one until it is whole."""
    spark = df.sparkSession
    folder = f"{base}/dir_step{step}"
    new, old = (f"{folder}/.{name}-{kind}-{uuid.uuid4().hex[:8]}" for kind in ("new", "old"))
    df.write.csv(new, sep="\t", header=header, quote="", escape="")
    fs, target = _file(spark, f"{folder}/{name}")
    if fs.exists(target):
        fs.rename(target, _file(spark, old)[1])
    if not fs.rename(_file(spark, new)[1], target):
        raise OSError(f"{name} could not be put in place; it is in {new}")
    fs.delete(_file(spark, old)[1], True)


__all__ = ["current_path", "load", "read_hits", "read_trees", "save", "save_text", "schemas"]
