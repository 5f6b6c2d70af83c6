"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is copied ``target / source_size`` times on average.  The whole part of that is
fixed; the fractional parts are rounded dependently: two documents exchange words (mass times size) until
one of them is integral, at random in the direction that keeps every document's expectation, so each step
keeps the source's words exactly.  A bucket of documents leaves at most one fractional residual; residuals
meet level by level in a reduction tree until each source has one, which a last draw rounds.  A source's
taken words therefore miss its target by less than the size of one document.

Random numbers are hashes of document keys: reruns and other partitionings agree.

Cases: a null text has size 0; documents of size 0 are never taken.  A null source is a source of its own,
sorted last.  Rows with equal doc_id, source and text are one unit: they share the decision and count with
all their words.  A null ``doc_id`` is a key like any other.  With no words at all every target is 0.
Extra columns are kept by :func:`mix_documents`; names that start with ``__ff_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, n_words, numbered, runs, stage

CAP = 3.0
EPS = 1e-9


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, key (binary MD5 of the text) and size in words of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", F.unhex(F.md5(text)).alias("key"), n_words(F.col("text")).alias("size"), *keep)


def targets(sized: DataFrame, weights: list[float], cap: float = CAP) -> DataFrame:
    """source, source_size, target.

    Sources in code point order, null last, have the ``weights`` in turn.  Targets are weight times one
    level, stopped at ``cap`` times the source's size; each round fixes the sources above the level and
    raises it for the others, and needs two sums of the source table.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(per_source.withColumn("__null", F.col("source").isNull()), ["__null", "source"], "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stage(ranked.select("source", "source_size", w.alias("weight"), (F.col("source_size") * cap).alias("most")), "sources")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while total:
        capped = F.col("weight") * level > F.col("most")
        fixed, free = table.agg(
            F.sum(F.when(capped, F.col("most")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))
        ).first()
        new = (total - fixed) / free if free else level
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def uniform(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from pairs of 64-bit hashes."""
    h = left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.view(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivot(mass: list[float], words: list[int], hashes: np.ndarray) -> tuple[list[float], int]:
    """Round fractional ``mass`` pairwise, keeping the sum of mass times words; index of the residual or -1."""
    mass = list(mass)
    open_at = -1
    for i in range(len(mass)):
        if mass[i] < EPS or mass[i] > 1 - EPS:
            mass[i] = float(round(mass[i]))
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b = open_at, i
        # words that can move from a to b, and from b to a
        down = min(mass[a] * words[a], (1 - mass[b]) * words[b])
        up = min((1 - mass[a]) * words[a], mass[b] * words[b])
        draw = uniform(hashes[a : a + 1], hashes[b : b + 1])[0]
        move = -down if draw * (down + up) < up else up
        mass[a] += move / words[a]
        mass[b] -= move / words[b]
        open_at = -1
        for j in (a, b):
            if mass[j] < EPS or mass[j] > 1 - EPS:
                mass[j] = float(round(mass[j]))
            else:
                open_at = j
    return mass, open_at


def _level(units: DataFrame, fan: int, last: bool) -> DataFrame:
    """One level of the tree: ``units`` with ``mass`` rounded inside each (source, bucket)."""
    names = units.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema)
    at = {n: names.index(n) for n in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, ["has_source", "source", "bucket"]):
            mass, words = table.column(at["mass"]).to_pylist(), table.column(at["words"]).to_pylist()
            hashes = table.column(at["hash"]).to_numpy()
            mass, rest = pivot(mass, words, hashes)
            if last and rest >= 0:
                draw = uniform(hashes[rest : rest + 1], np.array([len(names)]))[0]
                mass[rest] = 1.0 if draw < mass[rest] else 0.0
            table = table.set_column(at["mass"], "mass", pa.array(mass, pa.float64()))
            table = table.set_column(at["bucket"], "bucket", pa.array([b // fan for b in table.column(at["bucket"]).to_pylist()], pa.int64()))
            yield from table.combine_chunks().to_batches()

    keys = ["has_source", "source", "bucket"]
    # Long documents first: what stays open at the end is then a short one.
    dealt = units.repartition(*keys).sortWithinPartitions(*keys, F.desc("words"), "hash", "doc_id", "key")
    return map_arrow(dealt, run, schema)


def decide(
    sized: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), cap: float = CAP, bucket_rows: int = 4096, fan: int = 1024, seed: int = 5
) -> DataFrame:
    """Per unit: doc_id, source, key, size, rows, source_size, target, copies (long)."""
    goals = targets(sized, list(weights), cap)
    units = sized.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("rows"))
    counts = units.groupBy("source").agg(F.count("*").alias("n_units"))
    goals = goals.join(counts, goals["source"].eqNullSafe(counts["source"])).select(
        goals["source"].alias("__s"), "source_size", "target", "n_units"
    )
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    ratio = F.when(F.col("size") > 0, ratio).otherwise(0.0)
    table = units.join(goals, units["source"].eqNullSafe(goals["__s"])).drop("__s").withColumn("ratio", ratio)
    table = table.withColumn("whole", F.floor(F.col("ratio") + EPS).cast("long"))
    table = table.withColumn("mass", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
    table = table.withColumn("words", F.col("size") * F.col("rows"))
    table = table.withColumn("hash", F.xxhash64("doc_id", "key", F.lit(seed))).withColumn("has_source", F.col("source").isNotNull())
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_units") / bucket_rows)).cast("long")
    table = table.withColumn("bucket", F.pmod(F.xxhash64("hash", F.lit(1)), buckets)).drop("ratio", "n_units")
    fractional = (F.col("mass") > EPS) & (F.col("mass") < 1 - EPS)
    table = stage(table, "units")
    done = [table.where(~fractional)]
    most = int(counts.agg(F.max("n_units")).first()[0] or 0)
    buckets_left = -(-most // bucket_rows)
    open_units = table.where(fractional)
    while True:
        level = stage(_level(open_units, fan, buckets_left <= 1), "level")
        done.append(level.where(~fractional))
        if buckets_left <= 1:
            break
        open_units = level.where(fractional)
        buckets_left = -(-buckets_left // fan)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = F.col("whole") + F.round("mass").cast("long")
    return out.select("doc_id", "source", "key", "size", "rows", "source_size", "target", copies.alias("copies"))


def mix_report(docs: DataFrame, **params) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken (size times copies)."""
    units = decide(stage(sizes(docs), "sizes"), **params)
    each = units.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, all columns."""
    units = decide(stage(sizes(docs), "sizes"), **params).where("copies > 0")
    units = units.select(
        F.col("doc_id").alias("__ff_id"), F.col("source").alias("__ff_source"), F.col("key").alias("__ff_key"), F.col("copies").alias("__ff_n")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__ff_own", F.unhex(F.md5(text)))
    on = (
        (F.col("__ff_own") == F.col("__ff_key"))
        & F.col("doc_id").eqNullSafe(F.col("__ff_id"))
        & F.col("source").eqNullSafe(F.col("__ff_source"))
    )
    joined = keyed.join(units, on).select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__ff_n"))).alias("__ff_copy"))
    return joined.select(*docs.columns)
