"""FASTA files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions.strings import first_token


def list_proteomes(spark: SparkSession, directory: str, ext: str = ".fasta") -> DataFrame:
    """(species_id, file_name, file_size): files by size, largest first, ties by name.

    A row a file.  Raises if the folder is missing or holds no such file.
    """
    try:
        files = (
            spark.read.format("binaryFile").option("pathGlobFilter", f"*{ext}").load(directory)
            .select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"))
        )
        empty = files.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no directory {directory}") from e
        raise
    if empty:
        raise FileNotFoundError(f"no *{ext} file in {directory}")
    order = Window.orderBy(F.col("file_size").desc(), "file_name")
    return files.select((F.row_number().over(order) - 1).alias("species_id"), "file_name", "file_size")


def parse_records(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """Chunks of text, split before each line that starts with ``>``, to (header, name, seq).

    Lines are stripped on the right and joined, ``>`` goes from the header, and a
    chunk before the first header (``opens`` false) goes.
    """
    t = F.col(text_col)
    head = F.rtrim(F.regexp_replace(F.split(t, "\n", 2)[0], r"\s+$", ""))
    body = F.coalesce(F.try_element_at(F.split(t, "\n", 2), F.lit(2)), F.lit(""))
    header = F.replace(head, F.lit(">"), F.lit(""))
    return texts.where("opens").select(
        *(c for c in texts.columns if c not in (text_col, "opens")),
        header.alias("header"),
        first_token(header).alias("name"),
        F.regexp_replace(body, r"\s*\n|\s+$", "").alias("seq"),
    )


def read_fasta(spark: SparkSession, directory: str, ext: str = ".fasta", only: list[str] | None = None) -> DataFrame:
    """(file_name, pos, header, name, seq): the records of all files, numbered from 0 within a file.

    Files are split like any text; a record's place is counted within its
    split and shifted by the records of earlier splits, so no file is numbered in
    one task.  With ``only``, names of files, no other file is opened.
    """
    raw = spark.read.option("lineSep", "\n>").option("pathGlobFilter", f"*{ext}").text(directory)
    if only is not None:
        raw = raw.where(F.col("_metadata.file_name").isin(only))
    chunks = raw.select(
        "value",
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Only the first chunk of a file may lack a header: it keeps its own ">".
    first = F.row_number().over(Window.partitionBy("file_name", "block").orderBy("row")) == 1
    marked = chunks.withColumn("opens", ~((F.col("block") == 0) & first) | F.startswith("value", F.lit(">")))
    records = parse_records(marked)
    counts = records.groupBy("file_name", "block").count()
    before = Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("file_name", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("file_name", "block").orderBy("row")) - 1
    return records.withColumn("own", own).join(shift, ["file_name", "block"]).select(
        "file_name", (F.col("own") + F.col("shift")).alias("pos"), "header", "name", "seq"
    )


def number_proteins(species: DataFrame, records: DataFrame) -> DataFrame:
    """(protein_id, species_id, name, seq): ids run over the species in order and then over their records."""
    counts = species.join(records.groupBy("file_name").count(), "file_name", "left")
    before = Window.orderBy("species_id").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("file_name", "species_id", F.coalesce(F.sum(F.coalesce("count", F.lit(0))).over(before), F.lit(0)).alias("offset"))
    return records.join(F.broadcast(offset) if species.count() <= 100_000 else offset, "file_name").select(
        (F.col("offset") + F.col("pos")).cast("long").alias("protein_id"), F.col("species_id").cast("int").alias("species_id"), "name", "seq"
    )


def read_proteomes(spark: SparkSession, directory: str, ext: str = ".fasta") -> tuple[DataFrame, DataFrame]:
    """(species, protein) of a folder of FASTA files."""
    species = list_proteomes(spark, directory, ext)
    return species, number_proteins(species, read_fasta(spark, directory, ext))


def duplicate_names(records: DataFrame, name_col: str = "name", file_col: str = "file_name", order: tuple[str, ...] = ("file_name",)) -> DataFrame:
    """(protein_name, file1, file2): each repeat of a name, with the file of its first occurrence.

    ``order`` must tell rows apart.  First occurrences are aggregated on the map
    side and joined back, so a name of very many rows isn't one task's work.
    """
    place = F.struct(*order)
    first = records.groupBy(F.col(name_col).alias("protein_name")).agg(F.min(place).alias("first"), F.min_by(file_col, place).alias("file1"))
    return (
        records.join(first, F.col(name_col) == F.col("protein_name"))
        .where(place > F.col("first"))
        .select("protein_name", "file1", F.col(file_col).alias("file2"))
    )


def write_fasta(proteins: DataFrame, path: str) -> None:
    """One folder of FASTA text a species."""
    proteins.select("species_id", F.concat(F.lit(">"), F.col("protein_id").cast("string"), F.lit("\n"), F.col("seq")).alias("value")).write.partitionBy(
        "species_id"
    ).mode("overwrite").text(path)
