"""Clusters under a veto, in rounds: edges merge clusters in one order, unless the two would hold units that exclude each other.

Going through the edges one by one is the definition. The same clusters come from rounds over all tasks, by these facts: a
cluster that only grows keeps every collision, so an edge between clusters that collide is refused for good and goes; an edge
is applied exactly if both its ends are in one cluster at the end; and of a cluster A with its first remaining edge, to B,

- if the edge is B's first as well, nothing changes either before it, and it is applied;
- if B holds all contested keys of A, whatever B has become when the edge's turn comes holds them, too, and does not collide
  with itself, so A can't collide with it: the edge is applied. Until then A has no edge, and joining it to B early adds no
  contested key to B, so that no other decision changes. A cluster without contested keys is the common case.

Keys that nothing in reach of a cluster excludes can't collide and are left out from the start. In a round all edges found in
one of these ways are contracted at once; chains of them are, too, as keys only shrink along one. Clusters without contested
keys at least halve in a round. The first of all edges is always contracted, so rounds end; after ``MOST_ROUNDS`` what is left
goes through one task if it is small.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.operators.graph import ONE_TASK, components, written

MOST_ROUNDS = 24

Units = dict[str, set[tuple[str, str]]]  # of a cluster: by street, ZIP and unit


def collide(few: Units, many: Units) -> bool:
    """Whether a unit of one cluster and a unit of the other stand in one building and differ."""
    for street, units in few.items():
        for zip5, unit in units:
            if any(other != unit and not (zip5 and other_zip and zip5 != other_zip) for other_zip, other in many.get(street, ())):
                return True
    return False


def sequential(edges: list[tuple[int, int]], units: dict[int, Units]) -> dict[int, int]:
    """The cluster of every node, by edges in order. ``units`` of the nodes are used up."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        few, many = (a, b) if len(units.get(a, ())) <= len(units.get(b, ())) else (b, a)
        if a != b and not collide(units.get(few, {}), units.get(many, {})):
            # The cluster with more streets takes the other in, so that a unit moves a logarithmic number of times.
            root[few] = many
            for street, own in units.pop(few, {}).items():
                units.setdefault(many, {}).setdefault(street, set()).update(own)
    return {x: find(x) for x in root}


def _finish(edges: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    units: dict[int, Units] = {}
    for k in keys.itertuples():
        units.setdefault(k.cluster, {}).setdefault(k.street, set()).add((k.zip, k.unit))
    done = sequential([(e.a, e.b) for e in edges.sort_values("rank").itertuples()], units)
    return pd.DataFrame(list(done.items()), columns=["node", "root"])


def _colliding(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """``a, b`` of edges whose clusters exclude each other; each edge looks up the keys of the side that has fewer."""
    size = keys.groupBy("cluster").agg(F.count("*").alias("n"))
    both = edges.join(size.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
    turned = F.col("na") > F.col("nb")
    few = both.select("a", "b", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("cluster"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("other"))
    theirs = keys.select(F.col("cluster").alias("other"), "street", F.col("zip").alias("zip2"), F.col("unit").alias("unit2"))
    met = few.join(keys, "cluster").join(theirs, ["other", "street"])
    return met.where("unit <> unit2 and (zip = zip2 or zip = '' or zip2 = '')").select("a", "b").distinct()


def constrained(edges: DataFrame, keys: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``node, cluster`` for edges ``a, b, rank`` (all long, ranks differ) and contested keys ``node, street, zip, unit``."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    of = written(nodes.withColumn("cluster", F.col("node")), "clusters")
    keys = written(keys.withColumnRenamed("node", "cluster").distinct(), "keys")
    n = 0
    while True:
        edges = edges.join(_colliding(edges, keys), ["a", "b"], "left_anti")
        edges = written(edges, "edges")
        left = edges.count()
        if not left:
            return of
        if n >= MOST_ROUNDS and left <= one_task:
            one = [x.withColumn("one", F.lit(1)).groupBy("one") for x in (edges, keys)]
            roots = one[0].cogroup(one[1]).applyInPandas(lambda e, k: _finish(e, k), "node long, root long")
            edges = edges.limit(0)
        else:
            both = edges.select("a", "b", "rank").union(edges.select("b", "a", "rank"))
            first = written(both.groupBy("a").agg(F.min(F.struct("rank", "b")).alias("e")).select("a", "e.*"), "first")
            mutual = first.join(first.select(F.col("a").alias("b"), "rank"), ["b", "rank"]).select("a", "b")
            own = first.join(keys.withColumnRenamed("cluster", "a"), "a")
            lacking = own.join(keys.withColumnRenamed("cluster", "b"), ["b", "street", "zip", "unit"], "left_anti").select("a").distinct()
            roots = components(mutual.union(first.join(lacking, "a", "left_anti").select("a", "b")))
        roots = written(roots, "roots")

        def named(rows: DataFrame, name: str) -> DataFrame:
            found = rows.join(roots.select(F.col("node").alias(name), "root"), name, "left")  # noqa: B023
            return found.withColumn(name, F.coalesce("root", name)).drop("root")

        of = written(named(of, "cluster"), "clusters")
        keys = written(named(keys, "cluster").distinct(), "keys")
        joined = named(named(edges, "a"), "b").where("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("b")).agg(F.min("rank").alias("rank"))
        edges = joined.select(F.col("x").alias("a"), "b", "rank")
        n += 1
