"""Candidate contradictions: similar claims, quotas, pairs, verdicts, clusters, contexts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import chunk_text
from ..plans.staging import stage


@dataclass(frozen=True)
class Spec:
    """One kind of neighbour: how many, from the same document only, priority documents only, without local chunks."""

    limit: int
    same_document: bool = False
    priority_only: bool = False
    skip_local: bool = False


SPECS = (Spec(4, priority_only=True, skip_local=True), Spec(1, same_document=True), Spec(15, same_document=True, skip_local=True))


#: A side of one product of blocks holds at most so many bytes of vectors in double precision; tiles inside it have so many rows.
SIDE_BYTES, TILE = 32 << 20, 2048


def neighbours(claims: DataFrame, *, specs: tuple[Spec, ...] = SPECS, lower: float = 0.5, upper: float = 0.95, block: int = 2048, most_pivots: int = 256) -> DataFrame:
    """Nearest claims of each claim by kind: claim_id, spec, rank, other_id, score (cosine, double precision).

    ``claims``: claim_id, project_id, document_id, seq (of its chunk), priority, vector.  Exact.  Kinds of the same
    document compare the claims of a document only, all others those of a project, and where all of them want priority
    claims only these are compared with.  The claims of a group are cut into blocks of about ``block``; many blocks meet in
    one task (:func:`_between`), which leaves the best of each claim and kind only, and those of all tasks are ranked; pairs
    never become rows.  In a group of several blocks a block holds the claims nearest to one of at most ``most_pivots``
    claims, its pivot, and two blocks meet only if the angle of their pivots, less both radii, may give a score of ``lower``
    and of the lowest last place that a claim has inside its own block (:func:`block_pairs`).  ``upper`` applies after the
    limit, so a kind may yield fewer.  Vectors of no length, or shorter than the longest they meet, have cosine 0.
    """
    rows = claims.select("claim_id", "project_id", "document_id", "seq", "priority", "vector")
    found = None
    for same in (False, True):
        numbers = [n for n, s in enumerate(specs, 1) if s.same_document == same]
        if not numbers:
            continue
        best = _group_best(_by_document(rows, block) if same else rows, tuple(specs[n - 1] for n in numbers), lower, block, most_pivots)
        best = best.withColumn("spec", F.element_at(F.array(*[F.lit(n) for n in numbers]), F.col("spec")))
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("claim_id", "spec").orderBy(F.desc("score"), "other_id")
    limits = F.element_at(F.array(*[F.lit(s.limit) for s in specs]), F.col("spec"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limits)
    return ranked.where(F.col("score") <= upper).select("claim_id", "spec", "rank", "other_id", "score")


def _by_document(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with the groups in which claims of one document meet in place of projects: a long document, or several short ones."""
    project = F.coalesce(F.col("project_id").cast("string"), F.lit(""))
    keyed = rows.where("document_id is not null").withColumn("document_id", F.concat(F.length(project).cast("string"), F.lit(":"), project, F.col("document_id").cast("string")))
    sizes = stage(keyed.groupBy("document_id").agg(F.count("*").alias("__n")), "document-sizes")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    few = F.concat(F.lit("#"), F.pmod(F.xxhash64("document_id"), F.lit(total // block + 1)).cast("string"))
    return keyed.join(sizes, "document_id").withColumn("project_id", F.when(F.col("__n") > block, F.col("document_id")).otherwise(few)).drop("__n")


def _group_best(rows: DataFrame, specs: tuple[Spec, ...], lower: float, block: int, most_pivots: int) -> DataFrame:
    """claim_id, spec (place in ``specs``), other_id, score: no fewer than the best of each claim and kind among the claims of its ``project_id``."""
    sizes = stage(rows.groupBy("project_id").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("length")), "group-sizes")
    if sizes.where(F.col("n") > block).isEmpty():
        return _best(rows.withColumn("own", F.lit(0)).withColumn("bi", F.lit(0)).withColumn("bj", F.lit(0)), specs, lower)
    placed = stage(placed_in_blocks(rows, sizes, block, most_pivots), "blocks")
    inside = stage(_best(placed.withColumn("own", F.col("block")).withColumn("bi", F.col("block")).withColumn("bj", F.col("block")), specs, lower), "inside")
    pairs = stage(block_pairs(placed, inside, specs, lower), "block-pairs")
    return inside.unionByName(_between(placed, pairs, sizes.select("project_id", "length"), specs, lower))


def _between(placed: DataFrame, pairs: DataFrame, lengths: DataFrame, specs: tuple[Spec, ...], lower: float) -> DataFrame:
    """What :func:`_best` gives for ``pairs`` of blocks, many in one task.

    Blocks of a group are dealt to a few left and right sides; a claim travels once for each side that its block meets,
    not once for each block.  Where all kinds want priority claims, only these are on right sides.
    """
    wanted = F.col("priority") if all(s.priority_only for s in specs) else F.lit(True)
    groups = placed.groupBy("project_id").agg((F.max("block") + 1).alias("nb"), F.count("*").alias("n"), F.count_if(wanted).alias("m")).join(lengths, "project_id")
    most = F.greatest(F.lit(1), F.lit(SIDE_BYTES) / (8 * F.greatest("length", F.lit(1))))
    left = F.least("nb", F.greatest(F.lit(8), F.ceil(F.col("n") / most)))
    right = F.least("nb", F.greatest(F.lit(1), F.ceil(F.col("m") / most * 2)))
    groups = groups.select("project_id", F.ceil(F.col("nb") / left).alias("__l"), F.ceil(F.col("nb") / right).alias("__r"))
    both = pairs.unionByName(pairs.select("project_id", F.col("bj").alias("bi"), F.col("bi").alias("bj"))).join(groups, "project_id")
    both = both.select("project_id", F.floor(F.col("bi") / F.col("__l")).cast("int").alias("side"), F.floor(F.col("bj") / F.col("__r")).cast("int").alias("other"), "bi", "bj")
    lefts = stage(both.groupBy("project_id", "side", "other", F.col("bi").alias("block")).agg(F.sort_array(F.collect_list("bj")).alias("meets")), "left-sides")
    rights = stage(both.select("project_id", "side", "other", F.col("bj").alias("block")).distinct(), "right-sides")
    if pairs.count() <= 1_000_000:
        few_lefts, few_rights = F.broadcast(lefts), F.broadcast(rights)
    else:
        few_lefts, few_rights = lefts, rights
    rows = placed.join(few_lefts, ["project_id", "block"]).withColumn("right", F.lit(False))
    rows = rows.unionByName(placed.where(wanted).join(few_rights, ["project_id", "block"]).withColumn("right", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumnsRenamed({"block": "own", "side": "bi", "other": "bj"})
    return _met(rows, specs, lower, lefts.select("project_id", "side", "other").distinct().count())


def _best(rows: DataFrame, specs: tuple[Spec, ...], lower: float) -> DataFrame:
    """claim_id, spec, other_id, score: the best of each claim and kind in each pair (bi, bj) of blocks of a project."""
    return _met(rows.withColumn("meets", F.array(F.when(F.col("own") == F.col("bi"), F.col("bj")).otherwise(F.col("bi")))).withColumn("right", F.lit(True)), specs, lower)


def _met(rows: DataFrame, specs: tuple[Spec, ...], lower: float, tasks: int = 0) -> DataFrame:
    """claim_id, spec, other_id, score: in each group (project_id, bi, bj) the best of each claim with ``meets`` among the ``right`` claims of those blocks."""
    kind = rows.schema["claim_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group["claim_id"]))  # equals go to the smaller id
        ids, own, right = group["claim_id"], group["own"].to_numpy(), group["right"].to_numpy()
        code = np.concatenate([[0], np.cumsum(pc.not_equal(ids[1:], ids[:-1]).to_numpy())]) if len(ids) > 1 else np.zeros(len(ids), int)
        facts = {
            "code": code,
            "document": pd.factorize(group["document_id"].to_pandas())[0],
            "seq": group["seq"].to_numpy(),
            "priority": group["priority"].fill_null(False).to_numpy(),
            "unit": _units(group["vector"]),
        }
        waiting: dict[tuple, list[int]] = {}
        blocks, first = np.unique(np.where(group["meets"].is_valid().to_numpy(), own, -1), return_index=True)
        for b, at in zip(blocks, first, strict=True):
            if b >= 0:
                waiting.setdefault(tuple(group["meets"][int(at)].as_py()), []).append(b)
        is_left = group["meets"].is_valid().to_numpy()
        found: list[tuple] = []
        for meets, mine in waiting.items():
            found += _nearest(facts, np.flatnonzero(is_left & np.isin(own, mine)), np.flatnonzero(right & np.isin(own, meets)), specs, lower)
        claim, spec, other, score = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((int, np.int32, int, float)))
        return pa.table({"claim_id": ids.take(pa.array(claim)), "spec": pa.array(spec, pa.int32()), "other_id": ids.take(pa.array(other)), "score": pa.array(score, pa.float64())})

    keys = ["project_id", "bi", "bj"]
    dealt = rows.select(*keys, "claim_id", "document_id", "seq", "priority", "vector", "own", "right", "meets")
    if tasks:  # so many partitions that few groups share one, however few bytes they are
        dealt = dealt.repartition(min(4000, 3 * tasks), *keys)
    return dealt.groupBy(*keys).applyInArrow(run, f"claim_id {kind}, spec int, other_id {kind}, score double")


def _nearest(facts: dict, left: np.ndarray, right: np.ndarray, specs: tuple[Spec, ...], lower: float) -> list[tuple]:
    """(claims, kind, others, scores) by kind and tile: the best of ``left`` among ``right``, both numbers of rows in order of their ids.

    Products in single precision find the pairs that may reach a claim's last place so far, less their error; the scores
    that decide are in double precision.
    """
    code, document, seq = facts["code"], facts["document"], facts["seq"]
    if all(s.priority_only for s in specs):
        right = right[facts["priority"][right]]
    unit, out = facts["unit"], []
    other32, slack = unit[right].astype(np.float32), _slack(unit)
    for start in range(0, len(left), TILE):
        rows = left[start : start + TILE]
        own32 = unit[rows].astype(np.float32)
        floors = [np.full(len(rows), lower) for _ in specs]
        held = [(np.zeros(0, int), np.zeros(0), np.zeros(0, int)) for _ in specs]
        at, width = 0, TILE // 4
        while at < len(right):
            cut = np.minimum.reduce(floors) - slack
            flat = np.flatnonzero(own32 @ other32[at : at + width].T >= cut.astype(np.float32)[:, None])
            r, c = np.divmod(flat, min(width, len(right) - at))
            c += at
            at, width = at + width, min(2 * width, 2 * TILE)
            i, j = rows[r], right[c]
            scores = _exact(unit, i, j)
            ok = (code[i] != code[j]) & (scores >= lower)
            r, c, i, j, scores = r[ok], c[ok], i[ok], j[ok], scores[ok]
            known = (document[i] >= 0) & (document[j] >= 0)
            same = known & (document[i] == document[j])
            # without a document it is not known whether a claim is local
            local = (same | ~known) & (np.abs(seq[i] - seq[j]) <= 1)
            for k, spec in enumerate(specs):
                ok = scores >= floors[k][r]
                if spec.same_document:
                    ok &= same
                if spec.skip_local:
                    ok &= ~local
                if spec.priority_only:
                    ok &= facts["priority"][j]
                if ok.any():
                    held[k] = _first(*(np.concatenate(x) for x in zip(held[k], (r[ok], scores[ok], c[ok]), strict=True)), spec.limit, floors[k])
        out += [(rows[r], np.full(len(r), k, np.int32), right[c], scores) for k, (r, scores, c) in enumerate(held, 1)]
    return out


def _first(r: np.ndarray, scores: np.ndarray, c: np.ndarray, limit: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``limit`` best of each row, equals by ``c``; ``floor`` rises to a full row's last score."""
    order = np.lexsort((c, -scores, r))
    r, scores, c = r[order], scores[order], c[order]
    starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
    last = rank == limit - 1
    floor[r[last]] = scores[last]
    keep = rank < limit
    return r[keep], scores[keep], c[keep]


def _exact(unit: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows ``i`` and ``j`` in double precision, some at a time."""
    step = max(1, (1 << 22) // max(1, unit.shape[1]))
    parts = [np.einsum("ij,ij->i", unit[i[a : a + step]], unit[j[a : a + step]]) for a in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _slack(unit: np.ndarray) -> float:
    """More than the error of a product of two rows in single precision."""
    return (unit.shape[1] + 4) * 1.2e-7


def _units(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of length one; zero where they are shorter than the longest or have no direction."""
    lists = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    length = int(sizes.max(initial=0))
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    usable = sizes == length
    m = np.zeros((len(sizes), length))
    if length:
        m[usable] = values[np.repeat(usable, sizes)].reshape(-1, length)
    m = np.nan_to_num(m, nan=0.0, posinf=0.0, neginf=0.0)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def placed_in_blocks(rows: DataFrame, sizes: DataFrame, block: int, most_pivots: int) -> DataFrame:
    """``rows`` with block, pivot (its vector, null where the block has none) and angle to it.

    Pivots are claims of the lowest hashes.  A project is read in slices, each with the project's pivots beside it; what a
    pivot draws beyond ``block`` claims is cut by hash.  A vector of no length, or of another length than the pivots',
    lies in a block without a pivot.
    """
    mark = F.xxhash64("claim_id", F.lit(7))
    sized = rows.join(sizes, "project_id").withColumn("__p", F.least(F.lit(most_pivots), F.ceil(F.col("n") / F.lit(block))).cast("int"))
    some = sized.where(F.pmod(mark, F.greatest(F.lit(1), F.floor(F.col("n") / (8 * F.col("__p"))))) == 0)
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(mark, "claim_id"))
    pivots = some.select("project_id", "vector", "__p", "n", (rank - 1).alias("pivot")).where(F.col("pivot") < F.col("__p"))
    slices = F.ceil(F.col("n") / F.lit(4 * block)).cast("int")
    pivots = stage(pivots.select("project_id", "pivot", "vector", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice")), "pivots")
    sliced = sized.select(*rows.columns, F.pmod(F.xxhash64("claim_id", F.lit(8)), slices).cast("int").alias("slice"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def nearest(claims: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        centres = centres.sort_values("pivot")
        if not len(claims) or not len(centres):
            return claims.assign(pivot=-1, centre=None, angle=None)[[*kinds, "pivot", "centre", "angle"]]
        c = _unit(centres["vector"], centres)
        x = _unit(claims["vector"], centres)
        cosines = np.clip(x @ c.T, -1, 1)
        near, usable = cosines.argmax(1), (x != 0).any(1)
        angle = np.arccos(cosines[np.arange(len(x)), near])
        stacked = list(c)
        return claims.assign(
            pivot=np.where(usable, near, -1), centre=[stacked[k] if ok else None for k, ok in zip(near, usable, strict=True)], angle=np.where(usable, angle, np.nan)
        )[[*kinds, "pivot", "centre", "angle"]]

    shape = ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", pivot int, centre array<double>, angle double"
    drawn = sliced.groupBy("project_id", "slice").cogroup(pivots.groupBy("project_id", "slice")).applyInPandas(nearest, shape)
    drawn = stage(drawn.withColumn("angle", F.nanvl("angle", F.lit(None).cast("double"))), "drawn")
    parts = drawn.groupBy("project_id", "pivot").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("__parts"))
    first = F.coalesce(F.sum("__parts").over(Window.partitionBy("project_id").orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = parts.withColumn("__first", first.cast("int"))
    out = drawn.join(numbered, ["project_id", "pivot"])
    return out.select(*rows.columns, (F.col("__first") + F.pmod(F.xxhash64("claim_id", F.lit(9)), F.col("__parts"))).cast("int").alias("block"), "centre", "angle")


def block_pairs(placed: DataFrame, inside: DataFrame, specs: tuple[Spec, ...], lower: float) -> DataFrame:
    """project_id, bi, bj (bi < bj) of the blocks that may hold a neighbour of each other.

    No claim of one block is nearer to one of the other than the angle of their pivots less both radii.  A side wants the
    other if that angle's cosine reaches the lowest last place of its claims: for each kind the score at the limit among
    the neighbours inside the block, ``lower`` where there are fewer; kinds of priority claims only count where the other
    side has any.  Blocks without a pivot meet all others.
    """
    limits = F.element_at(F.array(*[F.lit(s.limit) for s in specs]), F.col("spec"))
    order = Window.partitionBy("claim_id", "spec").orderBy(F.desc("score"))
    last = inside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == limits).groupBy("claim_id").pivot("spec", list(range(1, len(specs) + 1))).agg(F.first("score"))
    held = placed.select("project_id", "block", "claim_id", "priority", "centre", "angle").join(last, "claim_id", "left")
    places = [F.min(F.coalesce(F.col(str(k)), F.lit(lower))).alias(f"s{k}") for k in range(1, len(specs) + 1)]
    blocks = held.groupBy("project_id", "block").agg(F.max("angle").alias("radius"), F.any_value("centre").alias("centre"), F.bool_or("priority").alias("priority"), *places)
    blocks = stage(blocks, "block-bounds")
    a, b = (blocks.select("project_id", *[F.col(c).alias(f"{c}_{x}") for c in blocks.columns[1:]]) for x in "ab")
    pairs = a.join(b, "project_id").where(F.col("block_a") < F.col("block_b"))
    cosine = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) - F.col("radius_a") - F.col("radius_b")
    bound = F.when(apart <= 0, 1.0).otherwise(F.cos(apart)) + 1e-7

    def wants(x: str, y: str):
        ok = F.lit(False)
        for k, spec in enumerate(specs, 1):
            reached = bound >= F.col(f"s{k}_{x}")
            ok = ok | (reached & F.col(f"priority_{y}") if spec.priority_only else reached)
        return ok

    free = F.col("centre_a").isNull() | F.col("centre_b").isNull() | (F.lit(lower) <= 0)
    met = pairs.where(free | wants("a", "b") | wants("b", "a"))
    return met.select("project_id", F.col("block_a").alias("bi"), F.col("block_b").alias("bj"))


def _unit(vectors: pd.Series, like: pd.DataFrame) -> np.ndarray:
    """Vectors as rows of length one, or zero."""
    length = max((len(v) for v in like["vector"] if v is not None), default=0)
    m = np.zeros((len(vectors), length))
    usable = np.array([v is not None and len(v) == length for v in vectors], dtype=bool)
    if length and usable.any():
        m[usable] = np.stack(vectors[usable].to_list()).astype(np.float64)
    m = np.nan_to_num(m, nan=0.0, posinf=0.0, neginf=0.0)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def quota_merge(near: DataFrame, *, most: int = 10) -> DataFrame:
    """claim_id, pos, other_id: kinds 1 and 2 first (with duplicates), kind 3 fills up with what they lack."""
    near = stage(near, "neighbours")  # it is read three times
    first = near.where("spec < 3")
    rest = near.where("spec = 3").join(first.select("claim_id", "other_id").distinct(), ["claim_id", "other_id"], "left_anti")
    order = Window.partitionBy("claim_id").orderBy("spec", "rank")
    return first.unionByName(rest).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most).select("claim_id", "pos", "other_id")


def unordered_once(bundles: DataFrame) -> DataFrame:
    """Each unordered pair where it occurs first: by claim, then position."""
    pair = Window.partitionBy(F.least("claim_id", "other_id"), F.greatest("claim_id", "other_id")).orderBy("claim_id", "pos")
    return bundles.withColumn("rn", F.row_number().over(pair)).where("rn = 1").drop("rn")


def verified(verdicts: DataFrame, threshold: int = 50) -> DataFrame:
    """Adds ``verified``: the second rating counts only if the first reaches the threshold."""
    second = F.coalesce(F.col("rating_2") >= threshold, F.lit(False))
    return verdicts.withColumn("verified", F.when(F.col("rating_1") >= threshold, second).otherwise(F.lit(False)))


def translate_hits(hits: DataFrame, bundles: DataFrame) -> DataFrame:
    """Numbers of a screener (1-based positions) back to claim ids; unknown numbers are dropped."""
    return hits.join(bundles.select("claim_id", F.col("pos").alias("index"), "other_id"), ["claim_id", "index"])


def similar_claims(claims: DataFrame, *, least: float = 0.95, block: int = 1024) -> DataFrame:
    """claim_id, other_id: links that connect all claims of a project with a cosine of at least ``least``.

    Exact, in pairs of blocks: eight a project, fewer where a block would have less than ``block`` claims, more where
    its vectors would exceed ``SIDE_BYTES``.  What leaves a pair of blocks is one link a claim, to the first claim of its
    component there, so a dense group stays linear in rows.  Pass only claims that occur in pairs.
    """
    keys = ["project_id", "bi", "bj"]
    most = F.greatest(F.lit(1), F.lit(SIDE_BYTES) / (8 * F.greatest(F.max(F.size("vector")), F.lit(1))))
    blocks = F.greatest(F.ceil(F.count("*") / most), F.least(F.lit(8), F.ceil(F.count("*") / F.lit(block)))).cast("int")
    sizes = stage(claims.groupBy("project_id").agg(blocks.alias("blocks")), "project-blocks")
    rows = claims.select("claim_id", "project_id", "vector").join(sizes, "project_id")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("claim_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("blocks", "other")
    kind = claims.schema["claim_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group["claim_id"]))
        own, unit = group["own"].to_numpy(), _units(group["vector"])
        inside = group["bi"][0].as_py() == group["bj"][0].as_py()
        left, right = (np.flatnonzero(own == group[k][0].as_py()) for k in ("bi", "bj"))
        root = np.arange(len(own))
        left32, right32, cut = unit[left].astype(np.float32), unit[right].astype(np.float32), np.float32(least - _slack(unit))
        for a in range(0, len(left), TILE):
            for b in range(a if inside else 0, len(right), TILE):
                i, j = np.nonzero(left32[a : a + TILE] @ right32[b : b + TILE].T >= cut)
                i, j = left[i + a], right[j + b]
                open_ = root[i] != root[j]
                i, j = i[open_], j[open_]
                near = _exact(unit, i, j) >= least
                i, j = i[near], j[near]
                while len(i):
                    # the greater root points to the least it meets, then each row to the root of its root
                    x, y = root[i], root[j]
                    np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                    while (root[root] != root).any():
                        root = root[root]
                    open_ = root[i] != root[j]
                    i, j = i[open_], j[open_]
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"claim_id": group["claim_id"].take(pa.array(moved)), "other_id": group["claim_id"].take(pa.array(root[moved]))})

    tasks = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    return rows.repartition(int(max(1, min(4000, 3 * tasks))), *keys).groupBy(*keys).applyInArrow(run, f"claim_id {kind}, other_id {kind}").distinct()


def pair_payloads(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """Both claims of each pair; pairs with an unknown claim have nulls and ``complete`` false."""
    side = lambda s: claims.select(F.col("claim_id").alias(f"claim_{s}_id"), F.col("document_id").alias(f"document_{s}"))
    out = pairs.join(side("a"), "claim_a_id", "left").join(side("b"), "claim_b_id", "left")
    return out.withColumn("complete", F.col("document_a").isNotNull() & F.col("document_b").isNotNull())


def pair_edges(pairs: DataFrame, similar: DataFrame) -> DataFrame:
    """Links (a, b) of contradiction pairs: a common claim, or claims that are similar across the pairs.

    ``pairs``: pair, claim_a_id, claim_b_id.  ``similar``: claim_id, other_id at or above the merge threshold.
    Pairs of one claim link to the least of them, not to each other.
    """
    held = pairs.select("pair", F.explode(F.array("claim_a_id", "claim_b_id")).alias("claim_id")).distinct()
    least = held.groupBy("claim_id").agg(F.min("pair").alias("least"))
    shared = held.join(least, "claim_id").select(F.col("pair").alias("a"), F.col("least").alias("b"))
    a = least.withColumnsRenamed({"least": "a"})
    b = least.withColumnsRenamed({"claim_id": "other_id", "least": "b"})
    return shared.unionByName(similar.join(a, "claim_id").join(b, "other_id").select("a", "b")).where("a <> b").distinct()


def clusters(pairs: DataFrame, components: DataFrame, most: int = 5) -> DataFrame:
    """cluster, members (ascending, at most ``most``) and n_dropped; pairs without links are clusters of one."""
    rooted = pairs.select("pair").join(components, F.col("pair") == F.col("node"), "left").select("pair", F.coalesce("root", "pair").alias("cluster"))
    rank = Window.partitionBy("cluster").orderBy("pair")
    kept = rooted.withColumn("rn", F.row_number().over(rank))
    return kept.groupBy("cluster").agg(
        F.array_sort(F.collect_list(F.when(F.col("rn") <= most, F.col("pair")))).alias("members"),
        F.count_if(F.col("rn") > most).alias("n_dropped"),
    )


def local_numbers(edges: DataFrame) -> DataFrame:
    """node, number: 1-based order of first appearance over (a, b) of the edges of a cluster, in edge order."""
    seen = edges.select("cluster", F.posexplode(F.array("a", "b")).alias("side", "node"), "ord")
    first = seen.groupBy("cluster", "node").agg(F.min(F.struct("ord", "side")).alias("first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("cluster").orderBy("first"))).drop("first")


def neighbour_window(chunks: DataFrame, before: int = 10, after: int = 1) -> DataFrame:
    """Ids of up to ``before`` previous and ``after`` next chunks of a document, in reading order."""
    w = Window.partitionBy("document_id").orderBy("seq")
    return chunks.select(
        "document_id",
        "seq",
        "chunk_id",
        F.collect_list("chunk_id").over(w.rowsBetween(-before, -1)).alias("previous"),
        F.collect_list("chunk_id").over(w.rowsBetween(1, after)).alias("following"),
    )


#: Fixed value: what stands for the middle of a long prefix.
CUT_MARK = "\n...[TRUNCATED]...\n"


def context_text(chunks: DataFrame, *, before: int = 10, after: int = 1, most_before: int = 5000, most_after: int = 500, head: float = 0.2) -> DataFrame:
    """Text around each chunk from chunks of the same heading; a long prefix keeps its first fifth and its end.

    ``chunks``: document_id, seq, chunk_id, toc_path, chunk_type, text, summary; each speaks as ``chunk_text`` has it.
    """
    chunks = chunks.withColumn("text", chunk_text(F.col("chunk_type"), F.col("text"), F.col("summary")))
    w = Window.partitionBy("document_id").orderBy("seq")
    near = F.struct("toc_path", "text")
    joined = lambda c: F.array_join(F.transform(F.filter(c, lambda x: x["toc_path"].eqNullSafe(F.col("toc_path"))), lambda x: x["text"]), "\n")
    out = chunks.withColumn("__b", F.collect_list(near).over(w.rowsBetween(-before, -1))).withColumn("__a", F.collect_list(near).over(w.rowsBetween(1, after)))
    first = int(most_before * head)
    prefix = joined(F.col("__b"))
    cut = F.concat(F.substring(prefix, 1, first), F.lit(CUT_MARK), F.right(prefix, F.lit(most_before - first)))
    return out.select(
        "document_id",
        "chunk_id",
        F.when(F.length(prefix) > most_before, cut).otherwise(prefix).alias("prefix"),
        F.substring(joined(F.col("__a")), 1, most_after).alias("suffix"),
    )
