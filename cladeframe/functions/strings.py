"""String and array expressions on sequences, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length ``k``, in order; empty if the sequence is shorter."""
    n = F.length(seq)
    found = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(n >= k, found).otherwise(F.array().cast("array<string>"))


def valid_kmer(kmer: Column, min_distinct: int, forbidden: str = "X*") -> Column:
    """At least ``min_distinct`` distinct characters and none of the forbidden."""
    out = F.size(F.array_distinct(F.split(kmer, ""))) >= min_distinct
    for c in forbidden:
        out = out & ~F.contains(kmer, F.lit(c))
    return out


def first_token(header: Column) -> Column:
    """The header up to its first space."""
    return F.substring_index(header, " ", 1)


def string_less(a: Column, b: Column) -> Column:
    """Order of ids as strings, so that 10 comes before 9."""
    return a.cast("string") < b.cast("string")


def cigar_parts(cigar: Column) -> Column:
    """array<struct<op,n>> of a CIGAR string."""
    pattern = r"(\d+)([A-Z])"
    ops = F.regexp_extract_all(cigar, F.lit(pattern), F.lit(2))
    sizes = F.regexp_extract_all(cigar, F.lit(pattern), F.lit(1))
    return F.zip_with(ops, sizes, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("n")))


def expand_hsp(seq: Column, start: Column, cigar: Column) -> Column:
    """Target characters in query columns from 1-based ``start``: M copies, D skips, I is gaps, others nothing."""
    zero = F.struct(start.cast("int").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        moved = F.when(p["op"].isin("M", "D"), p["n"]).otherwise(0)
        piece = (
            F.when(p["op"] == "M", F.substring(seq, acc["at"], p["n"]))
            .when(p["op"] == "I", F.repeat(F.lit("-"), p["n"]))
            .otherwise(F.lit(""))
        )
        return F.struct((acc["at"] + moved).alias("at"), F.concat(acc["out"], piece).alias("out"))

    return F.aggregate(cigar_parts(cigar), zero, step, lambda acc: acc["out"])
