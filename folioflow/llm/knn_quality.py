"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

Method: TF-IDF features of a bounded sample of labelled texts are factorized (truncated SVD); the labelled
latent vectors are broadcast.  The sample's texts stay in Spark: what comes to the driver is the ``terms`` most
frequent features and their counts in at most ``sample_rows`` texts.  Every document is projected, its cosines with all labelled vectors are
computed exactly as blocked matrix products, and the labels of its nearest neighbours vote with weights that
grow with similarity.  The vote's share becomes a probability through the labelled rows' own
leave-one-out votes.

Features of a text: whole words (Unicode lower case, cut of outer punctuation) that occur in the sample, and
pseudo-words for the shape of words (case, digits, punctuation) and for bins of length and repetition.  A word
or shape of more than ``LONG`` bytes is known by its hash.

Nothing but ``text`` enters a score.  Cases: null and empty texts have the single feature "empty" and get the
share of good labels among texts like them, or the overall share.  A null label is no label; labels that
contradict each other are averaged.  Without labels every score is 0.5.  Rows with a null ``doc_id`` are
scored, never learned from.  Of labelled texts at one cosine, where not all can vote, those of the lowest
``doc_id`` do.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_utf8, lowest, map_arrow, stage

#: Longer words and shapes are kept as 128-bit hashes, so that memory does not grow with their length.
LONG = 64
_OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
_LETTERS = bytes(c if not (chr(c).isascii() and chr(c).isalpha()) else (65 if chr(c).isupper() else 97) for c in range(256))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.pmod(crc32_utf8(doc_id), F.lit(5)) == 0, F.lit(False))


def shape(word: bytes) -> bytes:
    """A word's shape: runs of upper-case, lower-case or other letters count once, punctuation stays."""
    out = bytearray()
    for c in word.translate(_LETTERS):
        c = 97 if c >= 128 else 48 if 48 <= c < 58 else c
        if not out or out[-1] != c:
            out.append(c)
    return bytes(out)


def short(feature: bytes) -> bytes:
    return feature if len(feature) <= LONG else b"\x00h" + hashlib.blake2b(feature, digest_size=16).digest()


def word_features(word: bytes) -> tuple[bytes, bytes]:
    """The feature of a raw word (empty if nothing but punctuation) and that of its shape."""
    plain = word.decode("utf-8", "surrogatepass").lower().strip(_OUTER).encode("utf-8", "surrogatepass")
    return short(plain), short(b"\x00s" + shape(word))


class Features:
    """Feature counts of a text; remembers what frequent raw words turn into."""

    def __init__(self, most: int = 200_000):
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.most = most

    def __call__(self, text: str | None) -> Counter:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return Counter({b"\x00empty": 1})
        raw = Counter(words)
        out: Counter = Counter()
        if len(self.known) > self.most:
            self.known.clear()
        shapes: Counter = Counter()
        for w, n in raw.items():
            pair = self.known.get(w)
            if pair is None:
                pair = word_features(w)
                if len(w) <= LONG:
                    self.known[w] = pair
            out[pair[0]] += n
            shapes[pair[1]] += n
        total = len(words)
        out.pop(b"", None)
        for s, n in shapes.items():
            # the share of a shape in sixteenths, so that it weighs alike in texts of any length
            out[s] += 1 + 16 * n // total
        out[b"\x00n%d" % total.bit_length()] += 4
        out[b"\x00r%d" % (8 * len(raw) // total)] += 4
        stutter = sum(map(bytes.__eq__, words, words[1:]))
        out[b"\x00d%d" % min(8, -(-32 * stutter // total))] += 8
        return out


@dataclass
class LatentVotes:
    """What a task needs: vocabulary with weights, projection, labelled vectors, labels and calibration."""

    vocabulary: dict[bytes, int]
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float
    neighbours: int
    sharpness: float
    bins: np.ndarray
    values: np.ndarray

    def project(self, counted: list[Counter]) -> np.ndarray:
        get = self.vocabulary.get
        found = [[(k, n) for k, n in ((get(w), n) for w, n in c.items()) if k is not None] for c in counted]
        return self.embed([tuple(np.array(x) for x in zip(*f, strict=True)) if f else None for f in found])

    def embed(self, rows: list[tuple[np.ndarray, np.ndarray] | None]) -> np.ndarray:
        """Latent unit vectors of (ids, counts) rows; zero without any."""
        out = np.zeros((len(rows), self.projection.shape[1]), np.float32)
        for i, row in enumerate(rows):
            if row is not None:
                out[i] = (1 + np.log(row[1].astype(np.float32))) @ self.projection[row[0]]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    def vote(self, unit: np.ndarray, skip_self: bool = False) -> np.ndarray:
        """Similarity-weighted share of good labels among the nearest labelled vectors, block by block."""
        out = np.full(len(unit), self.share)
        k = min(self.neighbours + skip_self, len(self.vectors))
        if k == 0:
            return out
        for at in range(0, len(unit), 512):
            block = unit[at : at + 512]
            cosines = block @ self.vectors.T
            if skip_self:
                cosines[np.arange(len(block)), at + np.arange(len(block))] = -2
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(cosines, near, 1)
            # where more cosines than fit are equal to the last, the labelled rows of the lowest doc_id vote
            tied = np.flatnonzero((cosines >= value.min(1)[:, None]).sum(1) > k)
            near[tied] = np.argsort(-cosines[tied], axis=1, kind="stable")[:, :k]
            value[tied] = np.take_along_axis(cosines[tied], near[tied], 1)
            weight = np.where(value > 0, np.exp(self.sharpness * (value - 1)), 0).astype(np.float64)
            total = weight.sum(1)
            some = total > 0
            out[at : at + 512][some] = (weight * self.labels[near]).sum(1)[some] / total[some]
        return out

    def score(self, texts: list[str | None], features: Features) -> np.ndarray:
        """Probability of label 1 for each text, in 0 to 1."""
        if not len(self.vectors):
            return np.full(len(texts), 0.5)
        return np.interp(self.vote(self.project([features(t) for t in texts])), self.bins, self.values)


def fit(
    rows: list[tuple[np.ndarray, np.ndarray] | None],
    vocabulary: list[bytes],
    frequency: np.ndarray,
    labels: np.ndarray,
    *,
    rank: int = 96,
    neighbours: int = 15,
    sharpness: float = 12.0,
    seed: int = 13,
) -> LatentVotes:
    """Factorize the TF-IDF matrix of labelled texts and calibrate votes on it, leaving each text's own label out.

    ``rows``: ids in the vocabulary and counts of each text; ``frequency``: texts that hold each feature.
    """
    line = np.array([0.0, 1.0])
    if not len(labels) or not vocabulary:
        none = np.zeros((0, 1), np.float32)
        return LatentVotes({}, none, none, labels, 0.5, neighbours, sharpness, line, line)
    idf = np.log((1 + len(rows)) / (1 + frequency)) + 1
    at = np.concatenate([np.full(len(r[0]), i, np.int32) for i, r in enumerate(rows) if r is not None])
    cols = np.concatenate([r[0] for r in rows if r is not None]).astype(np.int32)
    values = ((1 + np.log(np.concatenate([r[1] for r in rows if r is not None]))) * idf[cols]).astype(np.float32)
    length = np.sqrt(np.bincount(at, values.astype(np.float64) ** 2, minlength=len(rows)))
    values = values / np.maximum(length[at], 1e-9).astype(np.float32)
    rank = max(1, min(rank, len(vocabulary), len(rows)))
    basis = _range_finder(at, cols, values, len(rows), len(vocabulary), rank, seed)
    projection = (idf[:, None] * basis).astype(np.float32)
    known = {w: i for i, w in enumerate(vocabulary)}
    model = LatentVotes(known, projection, np.zeros((0, basis.shape[1]), np.float32), labels, float(labels.mean()), neighbours, sharpness, line, line)
    model.vectors = model.embed(rows)
    model.bins, model.values = _monotone(model.vote(model.vectors, skip_self=True), labels)
    return model


def _product(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
    """Sparse (rows, cols, values) times a dense matrix; rows in slices so that memory stays small."""
    out = np.zeros((n, dense.shape[1]), np.float64)
    order = np.argsort(rows, kind="stable")
    for at in range(0, len(order), 1 << 16):
        part = order[at : at + (1 << 16)]
        r = rows[part]
        starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[starts]] += np.add.reduceat(values[part, None] * dense[cols[part]], starts, axis=0)
    return out


def _range_finder(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, m: int, rank: int, seed: int) -> np.ndarray:
    """Right singular vectors of the largest singular values (randomized subspace iteration)."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(_product(rows, cols, values, n, rng.standard_normal((m, min(m, rank + 8)))))[0]
    for _ in range(3):
        z = np.linalg.qr(_product(cols, rows, values, m, q))[0]
        q = np.linalg.qr(_product(rows, cols, values, n, z))[0]
    b = _product(cols, rows, values, m, q)
    u, _, _ = np.linalg.svd(b, full_matrices=False)
    return u[:, :rank]


def _monotone(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of good labels as a never falling function of the vote, from up to 20 equally filled bins."""
    order = np.argsort(votes, kind="stable")
    x = [float(p.mean()) for p in np.array_split(votes[order], 20) if len(p)]
    y = [float((p.sum() + 0.5) / (len(p) + 1)) for p in np.array_split(labels[order], 20) if len(p)]
    blocks: list[list[float]] = []
    for a, b in zip(x, y, strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            c = blocks.pop()
            p = blocks[-1]
            w = p[2] + c[2]
            blocks[-1] = [(p[0] * p[2] + c[0] * c[2]) / w, (p[1] * p[2] + c[1] * c[2]) / w, w]
    # the vote itself keeps a small part, so that no two votes tie
    xs = np.array([0.0, *[b[0] for b in blocks], 1.0])
    ys = np.array([0.0, *[b[1] for b in blocks], 1.0])
    xs, at = np.unique(xs, return_index=True)
    grid = np.unique(np.concatenate([xs, np.linspace(0, 1, 101)]))
    return grid, 0.98 * np.interp(grid, xs, ys[at]) + 0.02 * grid


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, seed: int) -> DataFrame:
    """doc_id, quality, text of at most ``sample_rows`` labelled texts outside the held-out fifth, half of each label where there are enough."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    mark = F.xxhash64("doc_id", F.lit(seed))
    usable = stage(usable, "usable-labels")
    chosen = [lowest(usable.where(c), mark, sample_rows // 2).orderBy(mark, "doc_id").limit(sample_rows // 2) for c in ("quality < 0.5", "quality >= 0.5")]
    picked = chosen[0].unionByName(chosen[1])
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.any_value("quality").alias("quality"), F.min("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 4096, terms: int = 20_000, seed: int = 13, **params) -> LatentVotes:
    """Fit on the sample: features are counted in tasks, the ``terms`` most frequent ones that two texts share are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            counted = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([list(c.keys()) for c in counted], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in counted], pa.list_(pa.int32())),
                ],
                names=["doc_id", "quality", "features", "counts"],
            )

    rows = training_rows(docs, labels, sample_rows, seed)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = stage(map_arrow(rows, run, f"doc_id {kind}, quality double, features array<binary>, counts array<int>"), "features")
    each = counted.select("doc_id", F.explode(F.arrays_zip("features", "counts")).alias("f")).select("doc_id", F.col("f.features").alias("feature"), F.col("f.counts").alias("n"))
    frequency = each.groupBy("feature").agg(F.count("*").alias("texts"))
    kept = frequency.where("texts > 1").orderBy(F.desc("texts"), "feature").limit(terms).collect()
    kept = kept or frequency.orderBy("feature").limit(terms).collect()
    vocabulary = [bytes(r["feature"]) for r in kept]
    ids = docs.sparkSession.createDataFrame([(w, i) for i, w in enumerate(vocabulary)], "feature binary, id int")
    held = each.join(F.broadcast(ids), "feature").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("f"))
    held = counted.select("doc_id", "quality").join(held, "doc_id", "left").select("doc_id", "quality", F.col("f.id").alias("ids"), F.col("f.n").alias("counts"))
    table = held.toArrow().sort_by("doc_id")
    pairs = zip(table.column("ids").to_pylist(), table.column("counts").to_pylist(), strict=True)
    sparse = [(np.array(i, np.int64), np.array(n, np.int64)) if i else None for i, n in pairs]
    qualities = np.array(table.column("quality").to_pylist(), dtype=np.float64)
    return fit(sparse, vocabulary, np.array([r["texts"] for r in kept], dtype=np.float64), qualities, seed=seed, **params)


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **params) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``sample_rows`` (4,096) bounds the labelled texts that are learned from and broadcast (as vectors), ``terms``
    (20,000) the features that are kept of them.  Every document is scored, with its whole text, in one pass
    without a shuffle.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, labels, **params))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, votes = Features(), model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                score = votes.score(batch.column(2).to_pylist(), features)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("__text"))
    return map_arrow(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
