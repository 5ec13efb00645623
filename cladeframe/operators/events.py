"""Orthology and paralogy events from ladders.

A ladder (query, leaf, step) is a rooted tree seen from its query: step is the
number of ancestors up to the last common one of query and leaf, 0 for the query.
All rules on trees here need only which leaves are attached at each step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.functions.storage import dealt_into, materialize, shuffle_partitions
from cladeframe.functions.strings import string_less


def _steps(ladder: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, step, sister, overlap, browsed) of ladders, sets of species as words of 64 bits.

    Ladders are dealt by their keys once; a step's species are one row for each
    64 of them, the union of earlier steps runs along, and sizes are bit counts.
    Species that aren't whole numbers are numbered within their ladder.
    """
    dealt = ladder.repartition(*keys)
    if not isinstance(ladder.schema["species"].dataType, T.IntegralType):
        dealt = dealt.withColumn("species", F.dense_rank().over(Window.partitionBy(*keys).orderBy("species")))
    species = F.col("species").cast("long")
    bit = F.expr("shiftleft(1L, CAST(pmod(CAST(species AS bigint), 64) AS int))")
    words = dealt.groupBy(*keys, "step", F.floor(species / 64).alias("word")).agg(F.bit_or(bit).alias("here"))
    earlier = Window.partitionBy(*keys, "word").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    seen = words.withColumn("known", F.col("here").bitwiseAND(F.coalesce(F.bit_or("here").over(earlier), F.lit(0))))
    per = seen.groupBy(*keys, "step").agg(F.sum(F.bit_count("here")).alias("sister"), F.sum(F.bit_count("known")).alias("overlap"))
    before = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("browsed", F.coalesce(F.sum(F.col("sister") - F.col("overlap")).over(before), F.lit(0)))


def step_species(ladder: DataFrame) -> DataFrame:
    """(query, step, sister, overlap, browsed) for each step above 0 that has leaves.

    ``ladder`` has a column species.  sister: species at the
    step; overlap: those of them also at an earlier step; browsed: species at earlier steps.
    """
    return _steps(ladder, ["query"]).where("step > 0")


def last_good(ladder: DataFrame, sp_overlap: float = 0.5) -> DataFrame:
    """(query, last_good): the rootmost step at which species of both sides overlap little enough, else 0."""
    steps = step_species(ladder)
    some = F.col("browsed") + F.col("sister") - F.col("overlap")
    ok = (some == 1) | (
        (F.col("overlap") / F.col("sister") <= sp_overlap) & (F.try_divide(F.col("overlap"), F.col("browsed")) <= sp_overlap)
    )
    return steps.groupBy("query").agg(F.coalesce(F.max(F.when(ok, F.col("step"))), F.lit(0)).alias("last_good"))


def label_leaves(ladder: DataFrame, sp_overlap: float = 0.5) -> DataFrame:
    """``ladder`` with ``ortho``: whether a leaf is on the query's side of its last good step."""
    good = last_good(ladder, sp_overlap)
    return ladder.join(good, "query", "left").withColumn("ortho", F.col("step") <= F.coalesce("last_good", F.lit(0))).drop("last_good")


#: Members of a list that stand in one block, on average.
BLOCK = 1000
#: Leaves and members whose pairs one task counts, on average.
ROWS = 100_000


def member_blocks(groups: DataFrame, keys: list[str], member: str, keep: list[str], block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The two sides (keys, i, j, member, keep) of a join that meets each two members of a list once.

    A list of more than ``block`` members is dealt into blocks by a hash of the
    member, and each pair of blocks i <= j has a key of its own: a member of block h
    stands left for all j >= h and right for all i <= h.  So no key has more than
    two blocks of rows, whatever the list, and a list of n members is sent
    n / ``block`` + 1 times, less than the pairs it makes.  Lists are counted on
    the map side first; the table of the long ones has a row for each ``block`` rows at most.
    """
    long = groups.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > block)
    long = long.select(*keys, F.ceil(F.col("__n") / block).alias("__k"))
    dealt = groups.select(*keys, F.col(member).alias("m"), *keep).join(long, keys, "left")
    k = F.coalesce("__k", F.lit(1)).cast("long")
    h = F.pmod(F.xxhash64("m"), k).cast("int")
    rows = dealt.select(*keys, "m", *keep, h.alias("h"), (k - 1).cast("int").alias("last"))
    left = rows.select(*keys, F.col("h").alias("i"), F.explode(F.sequence("h", "last")).alias("j"), F.col("m").alias("u"), *(F.col(c).alias(f"u_{c}") for c in keep))
    right = rows.select(*keys, F.explode(F.sequence(F.lit(0), F.col("h"))).alias("i"), F.col("h").alias("j"), F.col("m").alias("v"), *(F.col(c).alias(f"v_{c}") for c in keep))
    return left, right


def key_pairs(groups: DataFrame, keys: list[str], member: str, keep: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, a, b, a_keep, b_keep): pairs of each list's members, a before b as strings.

    A row makes many pairs, so both sides are dealt by the number of rows, ``ROWS``
    of them in a partition: by their bytes alone too many would stand together.
    """
    n = max(shuffle_partitions(groups.sparkSession), -(-groups.count() // ROWS))
    left, right = (side.repartition(n, *keys, "i", "j") for side in member_blocks(groups, keys, member, keep, block))
    ahead = string_less(F.col("u"), F.col("v"))
    # within a block both orders of two members meet, between blocks one
    met = left.join(right, [*keys, "i", "j"]).where(ahead | (F.col("i") < F.col("j")) & (F.col("u") != F.col("v")))
    turned = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    return met.select(
        *keys, turned("u", "v").alias("a"), turned("v", "u").alias("b"),
        *(turned(f"u_{c}", f"v_{c}").alias(f"a_{c}") for c in keep), *(turned(f"v_{c}", f"u_{c}").alias(f"b_{c}") for c in keep),
    )


def member_pairs(groups: DataFrame, member: str, *keep: str, block: int = BLOCK) -> DataFrame:
    """Pairs a, b of each query's members, a before b as strings, with ``a_``/``b_`` of the kept columns.

    ``groups`` is read four times, so it should be a table.
    """
    return key_pairs(groups, ["query"], member, list(keep), block)


def pair_counts(labelled: DataFrame, no_tree: DataFrame, min_ortho: int = 2) -> DataFrame:
    """(a, b, n_ortho, n_para) of pairs that are orthologous ``min_ortho`` times at least.

    Within a tree two leaves on the query's side are orthologous, and two of which
    one is are paralogous; members of a group without a tree are orthologous.
    """
    spark = labelled.sparkSession
    labelled = materialize(labelled.select("query", "leaf", "ortho"), "labelled")
    no_tree = materialize(no_tree.select("query", "member"), "no-tree")
    sides = []
    if not labelled.isEmpty():
        trees = member_pairs(labelled, "leaf", "ortho").where("a_ortho OR b_ortho")
        sides.append(trees.select("a", "b", (F.col("a_ortho") & F.col("b_ortho")).cast("long").alias("o"), (F.col("a_ortho") != F.col("b_ortho")).cast("long").alias("p")))
    if not no_tree.isEmpty() or not sides:
        sides.append(member_pairs(no_tree, "member").select("a", "b", F.lit(1).cast("long").alias("o"), F.lit(0).cast("long").alias("p")))
    met = reduce(DataFrame.unionByName, sides)
    counts = met.groupBy("a", "b").agg(F.sum("o").alias("n_ortho"), F.sum("p").alias("n_para")).where(F.col("n_ortho") >= min_ortho)
    with dealt_into(spark, (labelled.count() + no_tree.count()) // ROWS):
        return materialize(counts, "pair-counts")


def group_events(ladder: DataFrame, og: DataFrame) -> DataFrame:
    """(og_name, query, step, ortho): speciation or duplication at each step of a ladder cut down to a group.

    ``og`` is (og_name, protein_id); the query must be in the group.
    """
    return _events_of(_in_group(ladder, og))


def _events_of(own: DataFrame) -> DataFrame:
    o, s, b = F.col("overlap"), F.col("sister"), F.col("browsed")
    ortho = (b + s - o == 1) | (o == 0) | ((o == 1) & (s - o >= 2) & (b - o >= 2))
    return _steps(own, ["og_name", "query"]).where("step > 0").select("og_name", "query", "step", ortho.alias("ortho"))


def _in_group(ladder: DataFrame, og: DataFrame) -> DataFrame:
    queries = og.select("og_name", F.col("protein_id").alias("query"))
    leaves = og.select("og_name", F.col("protein_id").alias("leaf"))
    return ladder.join(queries, "query").join(leaves, ["og_name", "leaf"])


def group_pair_counts(ladder: DataFrame, no_tree: DataFrame, og: DataFrame) -> DataFrame:
    """(og_name, a, b, n_ortho, n_para): events of each pair over the trees and groups of an OG's members."""
    own = materialize(_in_group(ladder, og).select("og_name", "query", "leaf", "step", "species"), "own-leaves")
    events = _events_of(own)
    pairs = key_pairs(own, ["og_name", "query"], "leaf", ["step"]).where(F.col("a_step") != F.col("b_step"))
    told = pairs.withColumn("step", F.greatest("a_step", "b_step")).join(events, ["og_name", "query", "step"]).select(
        "og_name", F.col("b").alias("a"), F.col("a").alias("b"), F.col("ortho").cast("long").alias("o"), (~F.col("ortho")).cast("long").alias("p")
    )
    q = og.select("og_name", F.col("protein_id").alias("query"))
    m = og.select("og_name", F.col("protein_id").alias("member"))
    groups = materialize(no_tree.join(q, "query").join(m, ["og_name", "member"]).select("og_name", "query", "member"), "own-members")
    plain = key_pairs(groups, ["og_name", "query"], "member", []).select(
        "og_name", F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).cast("long").alias("o"), F.lit(0).cast("long").alias("p")
    )
    return told.unionByName(plain).groupBy("og_name", "a", "b").agg(F.sum("o").alias("n_ortho"), F.sum("p").alias("n_para"))


def ortholog_pairs(counts: DataFrame, ratio_ortho: float = 0.5) -> DataFrame:
    """Pairs whose share of orthologous events is above ``ratio_ortho``."""
    return counts.where(F.try_divide(F.col("n_ortho").cast("double"), F.col("n_ortho") + F.col("n_para")) > ratio_ortho)


def expand_pairs(pairs: DataFrame, cluster: DataFrame, protein: DataFrame, not_same_sp: bool = False, distinct: bool = False) -> DataFrame:
    """(name1, name2): pairs of representatives to pairs of their clusters' members.

    ``not_same_sp`` drops pairs of representatives of one species.
    """
    p = protein.select("protein_id", "species_id", "name")
    if not_same_sp:
        sp = p.select("protein_id", "species_id")
        pairs = (
            pairs.join(sp.toDF("a", "sa"), "a").join(sp.toDF("b", "sb"), "b").where("sa <> sb").drop("sa", "sb")
        )
    names = cluster.join(p, cluster["member_id"] == p["protein_id"]).select("rep_id", "name")
    out = pairs.join(names.toDF("a", "name1"), "a").join(names.toDF("b", "name2"), "b").select("name1", "name2")
    return out.distinct() if distinct else out
