"""Graph operators on edge and parent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage, unstage


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: ``edges(a, b)`` to ``(node, root)``, root the smallest node.

    Alternating large-star and small-star rounds: every round is a minimum per node and a join, so a hub
    with millions of links is summed map-side and joined as a splittable skewed key.  Null ends and loops
    are ignored; nodes without any link do not come out.  Rounds grow with the logarithm of the longest chain.
    """
    ok = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = stage(ok.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _fingerprint(now)
    while mark[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node link to the least around it
        large = stage(
            both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "large",
        )
        # small star: a node and its neighbours below it link to the least of them
        down = large.where(F.col("a") != F.col("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(lowest, "a")
            .where(F.col("b") != F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lowest.select("a", F.col("m").alias("b")))
            .distinct()
        )
        new = stage(small, "small")
        new_mark = _fingerprint(new)
        unstage(now)
        unstage(large)
        now = new
        if new_mark == mark:
            break
        mark = new_mark
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    ).first()
    return (r["n"], r["s"])


def descend(nodes: DataFrame, most_depth: int | None = None) -> DataFrame:
    """ancestor, node, depth of all nodes below each node, down to ``most_depth`` levels; ``nodes``: node, parent.

    Pairs double their reach in every round: those that span it are joined to all pairs known so far, so a tree of depth
    d takes log2(d) joins.  Without a limit a cycle has no end: it is an error that names one of its nodes.
    """
    pairs = nodes.where(F.col("parent").isNotNull()).select(F.col("parent").alias("ancestor"), "node", F.lit(1).alias("depth"))
    pairs, reach = stage(pairs, "descend"), 1
    while most_depth is None or reach < most_depth:
        longest = pairs.where(F.col("depth") == reach).select(F.col("ancestor").alias("__top"), F.col("node").alias("ancestor"))
        further = pairs.join(longest, "ancestor").select(F.col("__top").alias("ancestor"), "node", (F.col("depth") + reach).alias("depth"))
        if most_depth is not None:
            further = further.where(F.col("depth") <= most_depth)
        further = stage(further, "descend")
        if further.isEmpty():
            break
        if most_depth is None and (round_trip := further.where(F.col("ancestor") == F.col("node")).first()):
            raise ValueError(f"node {round_trip['node']} is below itself")
        pairs, reach = pairs.unionByName(further), reach * 2
    return pairs


def root_paths(links: DataFrame, keys: list[str], paths: list[str], *, on_cycle: str = "drop") -> DataFrame:
    """``links`` (keys, node, up, paths: arrays) with ``paths`` from the root down; a root's ``up`` is null.

    Every round a row's arrays are put behind those of the node it points to, and it points where that one points: the
    reach doubles, so depth d takes log2(d) joins whatever the shape.  Rows that lead to no root (their chain ends in a
    node that is not there, or in a cycle) have no path and are dropped; with ``on_cycle="error"`` a cycle is an error.
    A node that occurs more than once has a row for each of its paths.
    """
    others = [c for c in links.columns if c not in (*keys, "up", *paths)]
    now = stage(links, "paths")
    most = now.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while not (far := now.where(F.col("up").isNotNull())).isEmpty():
        if reach > most:
            if on_cycle == "error":
                raise ValueError(f"node {far.first()['node']} is below itself")
            break
        above = now.select(*keys, F.col("node").alias("up"), F.col("up").alias("__up"), *[F.col(p).alias(f"__{p}") for p in paths])
        joined = far.join(above, [*keys, "up"]).select(*keys, *others, F.col("__up").alias("up"), *[F.concat(f"__{p}", p).alias(p) for p in paths])
        before, now = now, stage(now.where("up is null").select(joined.columns).unionByName(joined), "paths")
        unstage(before)
        reach *= 2
    return now.where("up is null").drop("up")


def pre_order(nodes: DataFrame) -> DataFrame:
    """Zero-padded ids 0000, 0001, … in the order of ``ord`` inside each document."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return nodes.withColumn("node_id", F.lpad(rank.cast("string"), 4, "0"))
