"""Near-duplicate embeddings by an inverted multi-index.

Method: vectors of unit length are split into halves; independent codebooks of the halves form a product
grid of cells.  Every vector is stored in its own cell and probes the cells nearest to it in the order of a
multi-sequence traversal, until the cells visited hold the target share of vectors at the threshold's
distance (calibrated on the sample).  Pairs of stored and probing vectors are verified exactly, by cosine in
double precision, in blocks.  Only counts and spanning links leave a block.

A pair meets once: a vector probes no cell below its own.

Cases: vectors with a null label or without a usable direction (null, empty, all zero, null or non-finite
components) link with nothing and stay.  Equal vectors of a label are one class, verified once, and are links
of each other.  Vectors of different lengths never link.  Rows that repeat an id are vectors like others; a
null ``vec_id`` takes part, and a component of null ids alone has a null id.  Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, connected_components, lowest, map_arrow, runs, stage
from .ngram_join import class_node, local_roots, spanning


#: Equal vectors from which on their rows meet their verdict by broadcast.
FREQUENT = 1000


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Index pairs of two ascending lists in ascending order of their sums, up to ``limit``."""
    heap = [(float(first[0] + second[0]), 0, 0)]
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            return
        yield i, j
        if j + 1 < len(second):
            heapq.heappush(heap, (float(first[i] + second[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (float(first[i + 1] + second[0]), i + 1, 0))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _squared(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=k)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


@dataclass
class Grid:
    """Codebooks of both halves, for vectors of one length, and how much further than its own cell a vector looks."""

    first: np.ndarray
    second: np.ndarray
    reach: float

    def cells(self, unit: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Own cell and visited cells of each row."""
        cut, k = self.first.shape[1], len(self.second)
        a, b = _squared(unit[:, :cut], self.first), _squared(unit[:, cut:], self.second)
        order_a, order_b = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        a, b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
        for i in range(len(unit)):
            limit = a[i, 0] + b[i, 0] + self.reach
            visited = [int(order_a[i, p]) * k + int(order_b[i, q]) for p, q in multi_sequence(a[i], b[i], limit)]
            yield visited[0], visited


def fit_grid(sample: np.ndarray, k: int, threshold: float, target_recall: float, seed: int) -> Grid:
    """Codebooks of ``k`` centres a half, and the reach that finds ``target_recall`` of pairs at the threshold."""
    rng = np.random.default_rng(seed)
    n, length = sample.shape
    k = max(1, min(k, n))
    cut = max(1, length // 2)
    grid = Grid(k_means(sample[:, :cut], k, rng), k_means(sample[:, cut:], k, rng), 0.0)
    x = sample[rng.integers(0, n, 20_000)]
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(1)[:, None] * x
    norm = np.linalg.norm(u, axis=1)
    ok = norm > 1e-9
    x, u = x[ok], u[ok] / norm[ok, None]
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * u
    more = np.zeros(len(x))
    for part, centres in ((slice(0, cut), grid.first), (slice(cut, None), grid.second)):
        d, own = _squared(x[:, part], centres), _squared(y[:, part], centres).argmin(1)
        more += d[np.arange(len(x)), own] - d.min(1)
    grid.reach = float(np.quantile(more, target_recall)) if len(more) else 0.0
    return grid


def usable(label: Column, vector: Column) -> Column:
    limit = 1.7e308
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= limit))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists in double precision, scaled so that squares neither overflow nor vanish."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / np.abs(m).max(1)[:, None] if m.size else m


def _spread(classes: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """Each class in its own cell and as a probe in visited cells above it, in the grid of its length."""
    kind, least = (classes.schema[c].dataType.simpleString() for c in ("label", "least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                lengths = np.array(pc.list_value_length(batch.column(4)).to_numpy())
                row, cell, own = [], [], []
                for length in np.unique(lengths):
                    these = np.flatnonzero(lengths == length)
                    m = matrix(batch.column(4).take(pa.array(these)))
                    unit = m / np.linalg.norm(m, axis=1)[:, None]
                    grid = grids.get(int(length))
                    cells = grid.cells(unit) if grid else ((0, [0]) for _ in these)
                    for i, (mine, visited) in zip(these, cells, strict=True):
                        for c in visited:
                            if c >= mine:
                                row.append(int(i))
                                cell.append(c)
                                own.append(c == mine)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(take) for i in range(5)]
                    + [pa.array(lengths[row] if row else [], pa.int32()), pa.array(cell, pa.int32()), pa.array(own, pa.bool_())],
                    names=["key", "least", "label", "copies", "vector", "length", "cell", "own"],
                )

    item = classes.schema["vector"].dataType.simpleString()
    return map_arrow(
        classes.select("key", "least", "label", "copies", "vector"),
        run,
        f"key binary, least {least}, label {kind}, copies long, vector {item}, length int, cell int, own boolean",
    )


def _verify(placed: DataFrame, threshold: float) -> DataFrame:
    """Links of one block pair of a cell at a time: key and least of a class, its links, key and least of one it hangs together with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, bi, bj), t in runs(batches, ["label", "length", "cell", "bi", "bj"]):
            x = matrix(t.column("vector"))
            norm = np.linalg.norm(x, axis=1)
            block, own = t.column("block").to_numpy(), t.column("own").to_numpy()
            weight = t.column("copies").to_numpy()
            counts = np.zeros(len(x), np.int64)
            pairs = []
            jobs = [(np.flatnonzero(own), np.arange(len(x)))]
            if bi != bj:
                left, right = block == bi, block == bj
                jobs = [(np.flatnonzero(left & own), np.flatnonzero(right)), (np.flatnonzero(right & own), np.flatnonzero(left & ~own))]
            for a, b in jobs:
                if not len(a) or not len(b):
                    continue
                links = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= threshold
                if bi == bj:
                    links[np.arange(len(a)), a] = False
                counts[a] += links @ weight[b]
                other = ~own[b] if bi == bj else np.ones(len(b), bool)
                counts[b[other]] += links[:, other].T @ weight[a]
                if links.any():
                    found = spanning(links)
                    pairs.append(np.column_stack([a[found[:, 0]], b[found[:, 1]]]))
            out = np.flatnonzero(counts)
            if not len(out):
                continue
            roots = local_roots(len(x), np.concatenate(pairs))
            node, root = pa.array(out), pa.array(roots[out])
            columns = [t.column(c).take(at).combine_chunks() for at in (node, root) for c in ("key", "least")]
            yield pa.RecordBatch.from_arrays(
                [*columns[:2], pa.array(counts[out], pa.int64()), *columns[2:]], names=["key", "least", "links", "root_key", "root_least"]
            )

    least = placed.schema["least"].dataType.simpleString()
    return map_arrow(placed, run, f"key binary, least {least}, links long, root_key binary, root_least {least}")


def near_duplicates(
    vectors: DataFrame,
    *,
    threshold: float = 0.98,
    target_recall: float = 0.9995,
    sample_rows: int = 16_384,
    sample_bytes: int = 128 << 20,
    cell_rows: int = 256,
    most_centres: int = 256,
    block: int = 1024,
    seed: int = 3,
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Codebooks are fit on at most ``sample_rows`` classes (lowest hashes), fewer where the longest vectors would take more
    than ``sample_bytes`` (64 at least), for each length of vector in it;
    lengths that the sample lacks are so rare that one cell holds them.  Every vector is indexed.  A cell of
    a label holds about ``cell_rows`` vectors until a half has ``most_centres`` centres; fuller cells are cut
    into blocks of about ``block`` rows, each pair of which is a group of its own.
    """
    text = F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")
    identity = F.unhex(F.md5(F.concat(F.col("label").cast("string"), F.lit(":"), text)))
    keyed = vectors.select("vec_id", "label", F.col("embedding").alias("vector"), F.when(usable(F.col("label"), F.col("embedding")), identity).alias("key"))
    good = keyed.where(F.col("key").isNotNull())
    classes = stage(
        good.groupBy("key").agg(
            F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("vector").alias("vector")
        ),
        "classes",
    )
    none = keyed.where(F.col("key").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    mark = F.xxhash64("key", F.lit(seed))
    longest = classes.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return none
    rows = max(64, min(sample_rows, sample_bytes // (8 * longest)))
    sample = lowest(classes, mark, rows).orderBy(mark, "key").limit(rows).select("vector").toArrow().column("vector").combine_chunks()
    fullest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    grids = {}
    lengths = pc.list_value_length(sample)
    for length in sorted(pc.unique(lengths).to_pylist()):
        m = matrix(sample.filter(pc.equal(lengths, length)))
        centres = int(min(most_centres, max(1, math.ceil(math.sqrt(fullest * len(m) / len(sample) / cell_rows)))))
        grids[length] = fit_grid(m / np.linalg.norm(m, axis=1)[:, None], centres, threshold, target_recall, seed)

    spread = stage(_spread(classes, grids), "spread")
    cell = ["label", "length", "cell"]
    sizes = spread.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    placed = spread.join(sizes.drop("n"), cell).withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("blocks", "other")
    group = [*cell, "bi", "bj"]
    # block pairs of one cell go to partitions one after the other, so none takes several of them
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pair = (F.col("bj").cast("long") * (F.col("bj") + 1) / 2 + F.col("bi")).cast("long")
    part = F.pmod(F.pmod(F.xxhash64(*cell), F.lit(width)) + pair, F.lit(width)).cast("int")
    dealt = placed.withColumn("__part", part).repartitionById(width, "__part").drop("__part").sortWithinPartitions(*group)
    found = stage(_verify(dealt, threshold), "links")

    components = connected_components(found.select(class_node("least", "key").alias("a"), class_node("root_least", "root_key").alias("b")))
    components = components.select(F.col("node.key").alias("key"), F.col("root.id").alias("root_least"), F.lit(True).alias("linked"))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = classes.select("key", "least", "copies").join(counts, "key", "left").join(components, "key", "left")
    component = F.when(F.col("linked"), F.col("root_least")).otherwise(F.col("least")).alias("component_id")
    verdicts = joined.select("key", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), component)
    # rows of a key with many copies meet its verdict by broadcast; the others are shuffled, none of them a hot key
    verdicts = stage(verdicts.withColumnRenamed("copies", "__copies"), "verdicts")
    frequent = verdicts.where(F.col("__copies") >= FREQUENT).select("key", "n_links", "component_id")
    frequent = bounded(stage(frequent, "frequent"))
    ids = stage(good.select("vec_id", "key"), "ids")
    hot = ids.join(frequent, "key")
    cold = ids.join(frequent.select("key"), "key", "left_anti").join(verdicts.drop("__copies"), "key")
    out = hot.unionByName(cold).select("vec_id", "n_links", "component_id")
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).unionByName(none)
