"""Quality rules: rule statistics per text and an isolation forest over them.

Method: every tree splits a bounded sample of rows at random features and random values; rows that random
splits separate after few steps are anomalous.  The score is the usual ``2 ** (-mean path / c(sample))``.
The verdict threshold is calibrated on labelled rows.

Cases: a null text has no words; an empty text neither; both fail the base rule.  A null or repeated
``doc_id`` changes nothing, as every verdict is a function of the text alone.  Several labels of one document
count as good if one is good.  Without labelled rows nothing but the base rule rejects.  Extra columns are
kept by :func:`apply_rules` and never read; names that start with ``__ff_`` are reserved.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, lowest, map_arrow, stage

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_punct"]
_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of a whole text, in the order of ``STATS``; upper-case letters and punctuation are ASCII's."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(words) > 3:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(grams)
        if len(counts) < len(grams):
            end = 0  # words before it are counted
            for i, g in enumerate(grams):
                if counts[g] > 1:
                    repeated += i + 3 - max(end, i)
                    end = i + 3
    chars = len(text) - count(_SPACE)
    return (len(words), chars, count(_SYMBOLS), len(lines) - len(set(lines)), repeated, count(_UPPER), count(_PUNCT))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def features(stats: np.ndarray) -> np.ndarray:
    """Rates that do not depend on the length of a text; ``stats``: rows of STATS.

    Repetition below the base rule's half counts as nothing unless it covers a quarter of the words, and one
    repeated line is free: a line that a short text quotes twice is no anomaly.
    """
    s = np.asarray(stats, dtype=np.float64).reshape(-1, len(STATS))
    n, chars = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1)
    repeats = np.maximum(s[:, 4] / n - 0.25, 0)
    lines = np.maximum(s[:, 3] - 1, 0) / n
    return np.column_stack([s[:, 1] / n, s[:, 2] / chars, s[:, 5] / chars, s[:, 6] / chars, repeats, lines])


@dataclass
class Forest:
    """Trees as flat arrays: ``feature`` -1 marks a leaf, whose ``value`` is its path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots) or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.maximum(f, 0)] < self.value[at]
                at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)
            total += self.value[at]
        return 2.0 ** (-(total / len(self.roots)) / self.norm)


def _average_path(n: float) -> float:
    """Expected depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow_forest(x: np.ndarray, trees: int, rows_per_tree: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    feature: list[int] = []
    value: list[float] = []
    left: list[int] = []
    right: list[int] = []
    roots: list[int] = []
    size = min(rows_per_tree, len(x))
    depth_limit = max(1, math.ceil(math.log2(max(size, 2))))

    def leaf_or_split(rows: np.ndarray, depth: int) -> int:
        me = len(feature)
        feature.append(-1)
        value.append(depth + _average_path(len(rows)))
        left.append(-1)
        right.append(-1)
        if depth >= depth_limit or len(rows) <= 1:
            return me
        low, high = x[rows].min(0), x[rows].max(0)
        open_features = np.flatnonzero(high > low)
        if not len(open_features):
            return me
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        below = x[rows, f] < cut
        feature[me], value[me] = f, cut
        left[me] = leaf_or_split(rows[below], depth + 1)
        right[me] = leaf_or_split(rows[~below], depth + 1)
        return me

    for _ in range(trees if size else 0):
        roots.append(leaf_or_split(rng.choice(len(x), size, replace=False), 0))
    ints = lambda v: np.array(v, dtype=np.int64)
    return Forest(ints(feature), np.array(value), ints(left), ints(right), ints(roots), max(_average_path(size), 1e-9))


@dataclass
class RulesModel:
    forest: Forest
    threshold: float

    def kept(self, stats: np.ndarray) -> np.ndarray:
        """Verdict for rows of STATS."""
        s = np.asarray(stats, dtype=np.int64).reshape(-1, len(STATS))
        failed = (s[:, 0] < 50) | (100 * s[:, 4] > 50 * s[:, 0])
        return ~failed & (self.forest.score(features(s)) <= self.threshold)


def stats_table(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and STATS of every row; one pass over whole texts, no shuffle."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_stats(t) for t in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.int64)
            found = found.reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keys))] + [pa.array(found[:, i]) for i in range(len(STATS))],
                names=keys + STATS,
            )

    return map_arrow(docs.select(*keys, F.col("text").alias("__ff_text")), run, f"{schema}, " + ", ".join(f"{s} long" for s in STATS))


def fit(
    stats: DataFrame,
    labels: DataFrame,
    *,
    trees: int = 100,
    rows_per_tree: int = 256,
    sample_rows: int = 25_600,
    keep_good: float = 0.999,
    seed: int = 7,
) -> RulesModel:
    """Grow the forest and calibrate its threshold.

    ``stats``: doc_id and STATS.  The forest learns from at most ``sample_rows`` rows that pass the base rule
    (the lowest hashes of their ids), as its trees read ``rows_per_tree`` rows each anyway.  The threshold
    is the score up to which the share ``keep_good`` of all good labelled rows lie, moved to the middle of the
    gap above it among all labelled rows; they are scored in Spark, and two numbers come back.
    """
    passing = stats.where((F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words")))
    mark = F.xxhash64(F.col("doc_id"), F.lit(seed))
    sample = lowest(passing.select("doc_id", *STATS), mark, sample_rows).orderBy(mark, *STATS).limit(sample_rows).toPandas()
    forest = grow_forest(features(sample[STATS].to_numpy()), trees, rows_per_tree, seed)
    marked = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = passing.join(marked, "doc_id").select("quality", *STATS)
    known = stage(score_stats(known, RulesModel(forest, math.inf)).select("quality", "anomaly"), "known")
    floor = known.where("quality = 1").agg(F.percentile_approx("anomaly", keep_good, 100_000)).first()[0]
    if floor is None:
        return RulesModel(forest, math.inf)
    above = known.where(F.col("anomaly") > floor).agg(F.min("anomaly")).first()[0]
    return RulesModel(forest, floor if above is None else (floor + above) / 2)


def score_stats(stats: DataFrame, model: RulesModel) -> DataFrame:
    """``stats`` with base_failed, anomaly (double) and kept."""
    names = stats.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.column_stack([batch.column(names.index(c)).to_numpy() for c in STATS])
            failed = (s[:, 0] < 50) | (100 * s[:, 4] > 50 * s[:, 0])
            anomaly = model.forest.score(features(s))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(failed), pa.array(anomaly), pa.array(~failed & (anomaly <= model.threshold))],
                names=[*names, "base_failed", "anomaly", "kept"],
            )

    return map_arrow(stats, run, f"{schema}, base_failed boolean, anomaly double, kept boolean")


def score_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """One row per row of ``docs``: doc_id, STATS, base_failed, anomaly, kept."""
    stats = stage(stats_table(docs, ["doc_id"]), "stats")
    return score_stats(stats, fit(stats, labels, **params))


def apply_rules(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Statistics are counted once, beside the text, and written with the row: the fit and the verdict read the
    narrow column alone, and texts are never shuffled.
    """
    limit_batches(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{c} long" for c in STATS))
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(t) for t in texts], columns=STATS)

    rows = stage(docs.withColumn("__ff_stats", counted(F.col("text"))), "rows")
    model = fit(rows.select("doc_id", "__ff_stats.*"), labels, **params)

    @F.pandas_udf("boolean")
    def keeps(stats: pd.DataFrame) -> pd.Series:
        return pd.Series(model.kept(stats[STATS].to_numpy()))

    return rows.where(keeps(F.col("__ff_stats"))).select(*docs.columns)


def read_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, labels)
