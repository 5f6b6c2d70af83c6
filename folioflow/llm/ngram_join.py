"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Method: MinHash banding.  The number of bands follows from the rows of a band, the threshold and the target
recall.  Band hashes are shuffled with nothing but a 64-bit id; pairs of different texts that share a band
hash are the candidates, and only they are verified, on full n-gram sets.  Components of the candidate graph
serve to bring texts together: a component is cut into blocks, bounded in rows and bytes, and a text travels
to those blocks in which it has a candidate.  Every pair has one block pair, so it is verified once.  Only
counts and spanning links leave a block, never pairs, so a group of thousands of near copies stays linear in rows.

Words are ``[^\\x20\\x09-\\x0D]+`` as they stand.  A text of fewer than n words has one n-gram, all of it.

Cases: texts without a word (null, empty, blank) link with nothing.  Equal texts are one class, verified once,
and count as links of each other.  Rows with a null ``doc_id`` take part; a component whose documents all have
null ids has a null class id.  Repeated rows are copies like any other.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, connected_components, map_arrow, runs, stage

_CACHE = 200_000


def band_count(threshold: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` MinHash values that let a pair at the threshold through with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams; remembers hashes of frequent words."""

    def __init__(self, n: int):
        self.n = n
        self.known: dict[bytes, int] = {}
        odd = np.random.default_rng(11).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.factors = odd

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(h))
        last = len(h) - k + 1
        out = np.zeros(last, np.uint64)
        for i in range(k):
            out += h[i : i + last] * self.factors[i]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(32)))


def min_hashes(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values (upper 32 bits of multiply-add hashes), in slices that stay in the CPU's cache."""
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        np.minimum(best, (part[None, :] * factors[:, None] + offsets[:, None]).min(1), out=best)
    return best >> np.uint64(32)


def signatures(docs: DataFrame, *, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key (binary MD5 of the text), bytes of the text, bands (array of 64-bit hashes; null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        rng = np.random.default_rng(23)
        factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        offsets = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        mix = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            out = []
            for text in batch.column(3).to_pylist():
                found = shingle(text)
                if not len(found):
                    out.append(None)
                    continue
                m = min_hashes(found, factors, offsets).reshape(bands, rows)
                h = np.zeros(bands, np.uint64)
                for r in range(rows):
                    h = (h ^ m[:, r]) * mix[r]
                    h ^= h >> np.uint64(31)
                out.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "key", "bytes", "bands"]
            )

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    source = docs.select("doc_id", text_key().alias("key"), size.alias("bytes"), F.col("text").alias("__text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(source, run, f"doc_id {kind}, key binary, bytes long, bands array<long>")


def linked(sets: list[np.ndarray], threshold: float, others: list[np.ndarray] | None = None, width: int = 4096) -> np.ndarray:
    """Boolean matrix of pairs at or above the threshold, by exact intersections of full sets.

    Only n-grams that two texts share need columns; they pass through in slices of ``width``.
    """
    both = sets + (others or [])
    sizes = np.array([len(s) for s in both], np.int64)
    flat = np.concatenate(both) if both else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(both)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else np.empty(0, bool)
    owner, column = owner[shared], column[shared]
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
    cut = len(sets)
    columns = int(column[-1]) + 1 if len(column) else 0
    common = np.zeros((cut, len(both) - cut if others is not None else cut), np.float32)
    edges = np.searchsorted(column, np.arange(0, columns + width, width))
    for k in range(len(edges) - 1):
        a, b = edges[k], edges[k + 1]
        if a == b:
            continue
        m = np.zeros((len(both), width), np.float32)
        m[owner[a:b], column[a:b] - k * width] = 1
        common += m[:cut] @ (m[cut:] if others is not None else m[:cut]).T
    left, right = sizes[:cut], sizes[cut:] if others is not None else sizes[:cut]
    union = left[:, None] + right[None, :] - common
    return common >= threshold * union - 1e-6


def local_roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = find(int(a)), find(int(b))
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(n)])


def spanning(links: np.ndarray) -> np.ndarray:
    """Few of the True cells of a link matrix that connect what all of them connect: first and row-to-row links."""
    rows, cols = np.nonzero(links)
    if len(rows) <= 4 * sum(links.shape):
        return np.column_stack([rows, cols])
    # breadth-first over rows keeps a spanning forest
    seen_row, seen_col = np.zeros(links.shape[0], bool), np.zeros(links.shape[1], bool)
    out = []
    for start in range(links.shape[0]):
        if seen_row[start]:
            continue
        seen_row[start] = True
        wave = [start]
        while wave:
            r = wave.pop()
            fresh = np.flatnonzero(links[r] & ~seen_col)
            seen_col[fresh] = True
            out += [(r, c) for c in fresh]
            for c in fresh:
                more = np.flatnonzero(links[:, c] & ~seen_row)
                seen_row[more] = True
                out += [(q, c) for q in more]
                wave += more.tolist()
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def shared_bands(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Boolean matrix of the pairs of rows that share a band; columns are bands."""
    out = np.zeros((len(left), len(right)), bool)
    for band in range(left.shape[1]):
        out |= left[:, band, None] == right[None, :, band]
    return out


def verified(left: list[np.ndarray], right: list[np.ndarray], candidates: np.ndarray, threshold: float) -> np.ndarray:
    """The candidate pairs at or above the threshold; few pairs are intersected one by one, many as a matrix product."""
    if candidates.sum() * 16 > candidates.size:
        return candidates & linked(left, threshold, right)
    out = np.zeros_like(candidates)
    for i, j in zip(*np.nonzero(candidates), strict=True):
        common = len(np.intersect1d(left[i], right[j], assume_unique=True))
        out[i, j] = common >= threshold * (len(left[i]) + len(right[j]) - common) - 1e-6
    return out


def buckets(classes: DataFrame) -> DataFrame:
    """(id, value) of the band hashes that two or more texts share.

    ``id`` is a 64-bit hash of the key, ``value`` one of band and hash: a collision only adds a candidate,
    which the comparison of bands and then verification settle.
    """
    banded = classes.where(F.col("bands").isNotNull()).select("id", F.posexplode("bands").alias("band", "value"))
    banded = banded.select("id", F.xxhash64("band", "value").alias("value"))
    leaders = banded.groupBy("value").agg(F.min("id").alias("leader"), F.max("id").alias("last"))
    return banded.join(leaders.where(F.col("leader") != F.col("last")).drop("last"), "value")


def block_pairs(classes: DataFrame, *, block: int, block_bytes: int) -> DataFrame:
    """``classes`` of texts with a candidate, once for each block pair they are verified in: cluster, own, bi, bj.

    A component of the candidate graph is cut into blocks of about ``block`` texts and ``block_bytes`` bytes by
    the hash of the id.  A text goes to the pairs of its own block with blocks that hold a candidate of it.
    """
    shared = stage(buckets(classes), "buckets")
    links = shared.where(F.col("id") != F.col("leader")).select(F.col("id").alias("a"), F.col("leader").alias("b"))
    clusters = connected_components(links).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    members = stage(classes.join(clusters, "id"), "members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("bytes") / F.lit(block_bytes))).cast("int")
    large = bounded(stage(sizes.select("cluster", blocks.alias("blocks")).where("blocks > 1"), "large"))
    small = members.join(large, "cluster", "left_anti").withColumn("own", F.lit(0)).withColumn("other", F.lit(0))
    cut = members.join(large, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    cut = stage(cut, "cut")
    owns = stage(shared.select("id", "value").join(bounded(stage(cut.select("id", "own"), "own")), "id"), "owns")
    held = bounded(stage(owns.groupBy("value").agg(F.sort_array(F.collect_set("own")).alias("others")), "held"))
    mates = owns.join(held, "value").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
    spread = small.unionByName(cut.join(mates, "id").withColumn("other", F.explode("others")).drop("others"))
    return spread.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other", "id", "bytes")


def verify(docs: DataFrame, placed: DataFrame, *, n: int, threshold: float) -> DataFrame:
    """Links inside block pairs: key and doc_id of a text, its links, key and doc_id of one text it hangs together with.

    ``placed``: see :func:`block_pairs`; doc_id is that of one row that holds the text.
    """
    texts = docs.select(text_key().alias("key"), "doc_id", "text")
    holders = bounded(stage(placed.select("key", F.col("doc_id").alias("__id")).distinct(), "holders"))
    texts = texts.join(holders, "key").where(F.col("doc_id").eqNullSafe(F.col("__id"))).select("key", "text")
    # block pairs of one cluster go to partitions one after the other, so none takes several of them
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pair = F.col("bj").cast("long") * (F.col("bj") + 1) / 2 + F.col("bi")
    part = F.pmod(F.pmod(F.xxhash64("cluster"), F.lit(width)) + pair.cast("long"), F.lit(width)).cast("int")
    grouped = placed.join(texts, "key").withColumn("__part", part).repartitionById(width, "__part")
    grouped = grouped.sortWithinPartitions("cluster", "bi", "bj", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for (_, bi, bj), table in runs(batches, ["cluster", "bi", "bj"]):
            key = table.column("key").to_pylist()
            # repeated rows of the chosen document bring the text more than once
            first = [i for i in range(len(key)) if not i or key[i] != key[i - 1]]
            if len(first) < 2:
                continue
            own = table.column("own").to_numpy()
            bands = np.array(table.column("bands").combine_chunks().flatten()).reshape(len(key), -1)
            left = np.array([i for i in first if own[i] == bi], dtype=np.int64)
            right = left if bi == bj else np.array([i for i in first if own[i] != bi], dtype=np.int64)
            candidates = shared_bands(bands[left], bands[right])
            if bi == bj:
                np.fill_diagonal(candidates, False)
            rows, cols = candidates.any(1), candidates.any(0)
            if not rows.any():
                continue
            candidates, left, right = candidates[rows][:, cols], left[rows], right[cols]
            text = table.column("text")
            sets = {i: shingle(text[i].as_py()) for i in sorted({*left.tolist(), *right.tolist()})}
            links = verified([sets[i] for i in left.tolist()], [sets[i] for i in right.tolist()], candidates, threshold)
            if not links.any():
                continue
            weight = table.column("copies").to_numpy()
            both = left if bi == bj else np.concatenate([left, right])
            counts = links @ weight[right]
            pairs = spanning(links)
            if bi != bj:
                counts = np.concatenate([counts, links.T @ weight[left]])
                pairs = pairs + np.array([0, len(left)])
            roots = local_roots(len(both), pairs)
            out = np.flatnonzero(counts)
            node, root = pa.array(both[out]), pa.array(both[roots[out]])
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("key").take(node).combine_chunks(),
                    table.column("doc_id").take(node).combine_chunks(),
                    pa.array(counts[out], pa.int64()),
                    table.column("key").take(root).combine_chunks(),
                    table.column("doc_id").take(root).combine_chunks(),
                ],
                names=["key", "doc_id", "links", "root_key", "root_id"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["cluster", "bi", "bj", "own", "key", "doc_id", "copies", "bands", "text"]
    return map_arrow(grouped.select(*columns), run, f"key binary, doc_id {kind}, links long, root_key binary, root_id {kind}")


def class_node(doc_id: Column | str, key: Column | str) -> Column:
    """A node for graph components whose smallest is the one of the smallest id, null last: the root names its class."""
    return F.struct(F.isnull(doc_id).alias("none"), F.col(doc_id).alias("id"), F.col(key).alias("key"))


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def jaccard_classes(
    docs: DataFrame, *, n: int = 5, threshold: float = 0.8, rows: int = 6, recall: float = 0.9999, block: int = 512, block_bytes: int = 1 << 25
) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, n_links, component_id (smallest doc_id), kept.

    ``n_links`` counts the other documents at or above the threshold.  ``kept`` marks the one that stays of
    a component: its smallest ``doc_id``; a document without links stays.
    """
    bands = band_count(threshold, rows, recall)
    signed = stage(signatures(docs, n=n, bands=bands, rows=rows), "signatures")
    classes = signed.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.any_value("bytes").alias("bytes"), F.any_value("bands").alias("bands")
    )
    classes = stage(classes.withColumn("id", F.xxhash64("key")), "classes")
    placed = stage(block_pairs(classes, block=block, block_bytes=block_bytes), "placed")
    found = stage(verify(docs, placed, n=n, threshold=threshold), "links")
    components = connected_components(found.select(class_node("doc_id", "key").alias("a"), class_node("root_id", "root_key").alias("b")))
    components = components.select(F.col("node.key").alias("key"), F.col("root.id").alias("root_id"), F.lit(True).alias("linked"))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    summed = classes.select("key", F.col("doc_id").alias("least"), "copies", F.col("bands").isNotNull().alias("worded"))
    verdicts = summed.join(counts, "key", "left").join(components, "key", "left")
    verdicts = verdicts.withColumn("component_id", F.when(F.col("linked"), F.col("root_id")).otherwise(F.col("least")))
    out = signed.select("doc_id", "key").join(verdicts, "key")
    return out.select(
        "doc_id",
        "key",
        F.when(F.col("worded"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("worded"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, all their columns.

    What goes is found by id and text key.  Rows that repeat the chosen document (same id, same text) leave
    one; only texts of such rows are shuffled, and all texts where too many documents go for a broadcast.
    """
    verdict = stage(jaccard_classes(docs, **params).select(F.col("doc_id").alias("__ff_id"), F.col("key").alias("__ff_key"), "kept"), "verdict")
    keyed = docs.withColumn("__ff_own", text_key())
    on = (F.col("__ff_own") == F.col("__ff_key")) & F.col("doc_id").eqNullSafe(F.col("__ff_id"))
    gone = stage(verdict.where(~F.col("kept")).select("__ff_id", "__ff_key").distinct(), "gone")
    stays = keyed.join(bounded(gone), on, "left_anti")
    repeated = stage(verdict.where("kept").groupBy("__ff_id", "__ff_key").count().where("count > 1").drop("count"), "repeated")
    if repeated.isEmpty():
        return stays.drop("__ff_own")
    hinted = bounded(repeated)
    once = stays.join(hinted, on, "left_semi").dropDuplicates(["__ff_own", "doc_id"])
    return stays.join(hinted, on, "left_anti").unionByName(once).drop("__ff_own")
