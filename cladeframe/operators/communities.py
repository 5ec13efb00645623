"""Communities by asynchronous weighted label propagation within components.

In a round nodes are visited one after the other, and a node sees the labels that
earlier nodes took in the same round.  That order is kept, but it need not be
walked: in a round a node's label is a function of the new labels of its
neighbours that come before it and the old ones of those that come after, so the
round is the only solution of these equations.  It is found by setting all nodes
at once and then, again and again, those with an earlier neighbour that has
changed.  All nodes that the order lets be visited together are; what the first
k of such sets need is right after k steps, and mostly far fewer steps do.
Between rounds only nodes next to a change are looked at again.

Sums of weights are taken over multiples of 2**-40, so that they don't depend on
the order of addition; a hub's neighbours are summed by (node, label) where they
are read.  Components of up to ``in_task`` edges are gathered and walked in one
task each, as there may be very many of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.storage import discard, materialize
from cladeframe.operators.components import connected_components

MOST_ROUNDS = 10_000
#: Edges (two a pair) of a component that one task walks.
IN_TASK = 100_000
UNITS = 1 << 40


def components_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node; a node without edges is its own component."""
    found = connected_components(edges)
    return nodes.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def weight_units(weight: Column) -> Column:
    """A weight as a whole number of 2**-40, halves to even."""
    return F.rint(weight * F.lit(float(UNITS))).cast("long")


def propagate(nodes: list[tuple[int, float]], edges: dict[int, list[tuple[int, float]]]) -> dict[int, int]:
    """Labels of one component, walked node by node.

    Nodes are visited by coefficient, largest first, ties by id.  A node takes the
    label with the largest sum of edge weights among its neighbours; of equal sums
    the one met first, by weight (largest first) and then id.
    """
    label = {n: n for n, _ in nodes}
    order = [n for n, _ in sorted(nodes, key=lambda x: (-x[1], x[0]))]
    near = {n: sorted(((v, round(w * UNITS)) for v, w in edges.get(n, ())), key=lambda e: (-e[1], e[0])) for n in order}
    for _ in range(MOST_ROUNDS):
        changed = False
        for n in order:
            sums: dict[int, int] = {}
            for v, w in near[n]:
                sums[label[v]] = sums.get(label[v], 0) + w
            if sums:
                best = max(sums, key=sums.get)  # of equal sums the first that was met
                if best != label[n]:
                    label[n] = best
                    changed = True
        if not changed:
            return label
    raise RuntimeError(f"labels did not settle in {MOST_ROUNDS} rounds")


def _directed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w, earlier): whether dst is visited before src, and the weight in units."""
    at = nodes.select("id", "lcc")
    ends = edges.select("src", "dst", weight_units(F.col("weight")).alias("w"))
    ends = ends.join(at.toDF("src", "s"), "src").join(at.toDF("dst", "d"), "dst")
    earlier = (F.col("d") > F.col("s")) | (F.col("d") == F.col("s")) & (F.col("dst") < F.col("src"))
    return ends.select("src", "dst", "w", earlier.alias("earlier"))


def _vote(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, best): the label that each source of ``edges`` takes, from the labels now and before the round."""
    seen = edges.join(labels.select(F.col("id").alias("dst"), "now", "old"), "dst")
    seen = seen.select("src", F.when(F.col("earlier"), F.col("now")).otherwise(F.col("old")).alias("label"), "w", F.struct("w", (-F.col("dst")).alias("near")).alias("met"))
    votes = seen.groupBy("src", "label").agg(F.sum("w").alias("sum"), F.max("met").alias("met"))
    return votes.groupBy(F.col("src").alias("id")).agg(F.max_by("label", F.struct("sum", "met")).alias("best"))


def propagate_together(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) of ``nodes`` (id, lcc) as :func:`propagate` finds it, for components of any size.

    Each step is written, so a lost executor costs a step; a step sends the edges
    of the nodes that are looked at and a row a node.
    """
    edges = materialize(_directed(nodes, edges), "lp-edges")
    labels = materialize(nodes.select("id", F.col("id").alias("now"), F.col("id").alias("old"), F.lit(False).alias("moved")), "lp-labels")
    look = edges  # the edges of the nodes that are looked at
    for _ in range(MOST_ROUNDS):
        while True:
            new = labels.join(_vote(look, labels), "id", "left")
            new = new.select("id", F.coalesce("best", "now").alias("now"), "old", F.coalesce(F.col("best") != F.col("now"), F.lit(False)).alias("moved"))
            new = materialize(new, "lp-labels")
            discard(labels)
            labels = new
            moved = labels.where("moved").select(F.col("id").alias("dst"))
            if moved.isEmpty():
                break
            after = edges.where("earlier").join(moved, "dst", "left_semi").select("src").distinct()
            look = edges.join(after, "src", "left_semi")
        changed = labels.where("now <> old").select(F.col("id").alias("dst"))
        if changed.isEmpty():
            return labels.select("id", F.col("now").alias("label"))
        after = edges.where("NOT earlier").join(changed, "dst", "left_semi").select("src").distinct()
        new = materialize(labels.select("id", "now", F.col("now").alias("old"), F.lit(False).alias("moved")), "lp-labels")
        look = edges.join(materialize(after, "lp-look"), "src", "left_semi")
        discard(labels)
        labels = new
    raise RuntimeError(f"labels did not settle in {MOST_ROUNDS} rounds")


def communities(nodes: DataFrame, edges: DataFrame, members: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(id, component, og, split): og is a label; split, whether its component has several.

    ``nodes`` has id, species and lcc, ``members`` id and component.  Components
    of fewer than 4 nodes or of one species are communities as they are.
    """
    full = materialize(members.join(nodes.select("id", "species", "lcc"), "id"), "lp-members")
    kind = full.groupBy("component").agg(F.count("*").alias("size"), F.countDistinct("species").alias("n_species"))
    size = edges.join(full.select(F.col("id").alias("src"), "component"), "src").groupBy("component").agg(F.count("*").alias("n_edges"))
    plain = (F.col("size") < 4) | (F.col("n_species") == 1)
    way = F.when(plain, 0).when(F.coalesce("n_edges", F.lit(0)) <= in_task, 1).otherwise(2)
    kind = kind.join(size, "component", "left").select("component", way.alias("way"))
    full = materialize(full.join(kind, "component"), "lp-ways")

    rows = full.where("way = 1").join(edges.select(F.col("src").alias("id"), "dst", "weight"), "id", "left")
    rows = rows.select("component", "id", "lcc", F.coalesce("dst", "id").alias("dst"), "weight")  # no null id, which pandas would read as a float

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list] = {}
        lcc = {}
        for i, x, v, w in zip(pdf["id"], pdf["lcc"], pdf["dst"], pdf["weight"]):
            lcc[int(i)] = float(x)
            if w == w:
                near.setdefault(int(i), []).append((int(v), float(w)))
        label = propagate(list(lcc.items()), near)
        return pd.DataFrame({"id": list(label), "component": int(pdf["component"].iloc[0]), "og": list(label.values())})

    found = full.where("way = 0").select("id", "component", F.col("component").alias("og"))
    found = found.unionByName(rows.groupBy("component").applyInPandas(run, "id long, component long, og long"))
    large = full.where("way = 2")
    if not large.isEmpty():
        ids = large.select("id", "lcc")
        own = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
        found = found.unionByName(large.select("id", "component").join(propagate_together(ids, own).withColumnRenamed("label", "og"), "id"))
    found = materialize(found, "lp-found")
    several = found.groupBy("component").agg((F.countDistinct("og") > 1).alias("split"))
    return found.join(several, "component").select("id", "component", "og", "split")
