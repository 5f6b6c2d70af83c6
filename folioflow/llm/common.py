"""What the training-data operators share: staged tables, graph components, word splitting.

Words everywhere are maximal runs of ``[^\\x20\\x09-\\x0D]+``.  On UTF-8 bytes that is what
``bytes.split()`` without an argument yields, so Python tasks split bytes, not text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import connected_components  # noqa: F401
from ..plans.staging import new_path, stage, unstage  # noqa: F401

#: One word, as a Java / RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null; JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_utf8(value: Column) -> Column:
    return F.crc32(F.encode(value.cast("string"), "UTF-8"))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number all rows 0.. by ``order`` without bringing them into one task.

    Range partitions are numbered each for itself; their offsets, one number a partition, come from
    the driver.
    """
    spark = df.sparkSession
    ranged = stage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranged"
    )
    counts = sorted(tuple(r) for r in ranged.groupBy("__part").count().collect())
    offset, offsets = 0, []
    for part, n in counts:
        offsets.append((part, offset))
        offset += n
    starts = spark.createDataFrame(offsets or [(-1, 0)], "__part int, __offset long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)).cast("long")
    return (
        ranged.withColumn("__row", within)
        .join(F.broadcast(starts), "__part")
        .withColumn(out, F.col("__row") - 1 + F.col("__offset"))
        .drop("__part", "__row", "__offset")
    )


def ranked(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each group 0.. by ``order``, without a window and without a task that holds a whole group.

    Rows are range partitioned by ``group`` and ``order``, so a large group lies in many partitions; a row's place in its
    partition is in the number that Spark gives it.  One row for each group of each partition (at most groups plus
    partitions) is added up and joined back.  Rows that tie in everything get their numbers at will.
    """
    by = [*group, *order, "__tie"]
    mine = ["__part", *group]
    tied = df.withColumn("__tie", F.monotonically_increasing_id())  # spreads equal rows; their places do not matter
    placed = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    placed = stage(placed, "ranked").withColumn("__part", F.shiftright("__at", 33))
    heads = placed.groupBy(*mine).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    heads = stage(heads.select(*mine, shift.alias("__shift")), "heads")
    return null_safe(placed, bounded(heads), mine, "inner").withColumn(out, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of a partition that is sorted by ``keys``, one at a time, over batch borders."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        start = 0
        values = list(zip(*columns, strict=True))
        for i, key in enumerate(values):
            if key != last:
                if last is not None:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield last, pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(batch.slice(start))
    if last is not None:
        yield last, pa.Table.from_batches(held)


#: Rows hold whole texts: batches of more rows than this would hold too much at once.
BATCH_ROWS = 2000


def release() -> None:
    """Give memory that a finished task's Arrow buffers and caches held back to the system, as workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def limit_batches(spark: SparkSession) -> None:
    """Batches of at most ``BATCH_ROWS`` rows, for the session from then on: Spark reads the setting when a plan runs."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH_ROWS`` rows (see :func:`limit_batches`)."""
    limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def value_of(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once: inside a lambda it is no expression any more."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def bounded(small: DataFrame, most_rows: int = 250_000, most_bytes: int = 32 << 20) -> DataFrame:
    """A staged table (keys and ids) with a broadcast hint if it has at most ``most_rows`` rows in files of ``most_bytes``; else it is shuffled.

    What is not staged yet is staged first, so that it is not computed once for the count and again for the join.
    """
    if not getattr(small, "_staged_at", None):
        small = stage(small, "bounded")
    path = small.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(small._staged_at)
    system = path.getFileSystem(small.sparkSession.sparkContext._jsc.hadoopConfiguration())
    fits = system.getContentSummary(path).getLength() <= most_bytes and small.count() <= most_rows
    return F.broadcast(small) if fits else small.hint("merge")


def lowest(rows: DataFrame, mark: Column, n: int) -> DataFrame:
    """``rows`` without most of those that are not among the ``n`` of the lowest 64-bit hashes ``mark``.

    Sorting with a limit brings ``n`` rows of every partition to the driver; after this cut about 2 n rows are left of all.
    """
    total = rows.count()
    if total <= 2 * n:
        return rows
    few = rows.where(mark < F.lit(int(-(2.0**63) + 2.0**64 * min(1.0, 2 * n / total) * (1 - 1e-12))))
    return few if few.count() >= n else rows


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` with null equal to null; the right side's keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        on = c if on is None else on & c
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])
