"""Stored tables in buckets of a key, so that an upsert writes anew only what it touches.

A row lies in the folder ``bucket=n`` of its key's hash.  An upsert reads the buckets of its keys alone, and only their
files are replaced; all others stay as they are, byte for byte.  The stored rows of a touched bucket are not shuffled while
the keys of the upsert fit a broadcast of checked size.  The new content is staged before it replaces the old one, so
nothing is read and overwritten at once; Spark moves the buckets into place when all of them are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import stage

#: Keys of an upsert up to which the stored side is read without a shuffle.
MOST_KEYS = 250_000


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """A new table of ``rows``, one file a bucket."""
    dealt = rows.withColumn("bucket", _bucket(keys, buckets)).repartition(buckets, "bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def replace_groups(path: str, new: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """Rows of ``new`` take the place of all stored rows of their keys; returns the buckets that were written.

    ``keys`` and ``buckets`` are those the table was written with.  Null keys equal each other.
    """
    spark = new.sparkSession
    new = stage(new.withColumn("bucket", _bucket(keys, buckets)), "new-rows")
    gone = stage(new.select("bucket", *keys).distinct(), "new-keys")
    touched = sorted(r[0] for r in gone.select("bucket").distinct().collect())  # at most as many as there are buckets
    if not touched:
        return []
    stored = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    small = F.broadcast(gone) if gone.count() <= MOST_KEYS else gone
    mine = small.select(*[F.col(c).alias(f"__{c}") for c in ("bucket", *keys)])
    on = [F.col("bucket") == F.col("__bucket"), *[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]]
    merged = stage(stored.join(mine, on, "left_anti").unionByName(new, allowMissingColumns=True), "merged")
    merged.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def upsert_claims(path: str, claims: DataFrame, embed: Callable[[Column], Column], buckets: int) -> list[int]:
    """Claims (project_id, document_id, claim_id, text, others) embedded and stored; all earlier claims of their documents go."""
    return replace_groups(path, claims.withColumn("vector", embed(F.col("text"))), ["project_id", "document_id"], buckets)
