"""Reading tables and JSON documents; the batch sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import page_numbers


def files_ending(files: DataFrame, ending: str, project=None) -> DataFrame:
    """Live files of a project (all projects without one) whose name has an ending, such as ``_processed.json``."""
    out = files.where(~F.col("deleted") & F.col("filename").endswith(ending))
    return out if project is None else out.where(F.col("project_id") == project)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a join's larger side that a task sorts, about.
TASK_ROWS = 1_000_000


def dealt_for_join(large: DataFrame, key: str, other: DataFrame, other_key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join dealt out by their keys, so that a task sorts about ``TASK_ROWS`` of the larger one; as they are where the cores' tasks do.

    Left alone, Spark puts blocks together by their packed bytes, which are few for narrow columns however many rows they
    hold, until there are no more tasks than cores; what a task sorts then grows with the table.
    """
    tasks = -(-large.count() // TASK_ROWS)
    if tasks <= large.sparkSession.sparkContext.defaultParallelism:
        return large, other
    return large.repartition(tasks, key), other.repartition(tasks, other_key)


#: Document JSON as the extraction writes it; free-form metadata stays a map.
DOCUMENT = (
    "document_name string, markdown string, pages int, chunks array<struct<chunk_id:string, page_content:string, "
    "metadata:map<string,string>, page_numbers:array<int>, "
    "sub_chunks:array<struct<chunk_id:string, page_content:string, metadata:map<string,string>, page_numbers:array<int>>>>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Processed documents, one JSON object a file; the schema is given, so nothing is inferred."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def chunks_up_to_page(documents: DataFrame, n: int) -> DataFrame:
    """document_name, seq, chunk, error: chunks any page of which is at most ``n``.

    A document that could not be read (null chunks) is one row with an error.
    """
    chunks = documents.select("document_name", F.posexplode("chunks").alias("seq", "chunk"))
    found = chunks.where(F.exists("chunk.page_numbers", lambda p: p <= n)).withColumn("error", F.lit(None).cast("string"))
    missing = documents.where("chunks is null").select("document_name", F.lit("not found").alias("error"))
    return found.unionByName(missing, allowMissingColumns=True)


def sub_chunks_up_to_page(documents: DataFrame, n: int) -> DataFrame:
    chunks = documents.select("document_name", F.posexplode("chunks").alias("seq", "chunk"))
    subs = chunks.select("document_name", "seq", F.posexplode("chunk.sub_chunks").alias("sub", "sub_chunk"))
    return subs.where(F.exists("sub_chunk.page_numbers", lambda p: p <= n))


def write_documents(documents: DataFrame, path: str) -> None:
    """Sink: one JSON object a line; ``pages`` is the highest page mark of the markdown, absent without one."""
    documents.withColumn("pages", F.array_max(page_numbers(F.col("markdown")))).write.mode("overwrite").json(path)


def merged_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """One row a job: the ``contradictions`` of its checkpoint files, in the order of their names."""
    each = checkpoints.select("job_id", "path", F.posexplode("contradictions").alias("at", "c"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "at", "c"))), lambda x: x["c"])
    return each.groupBy("job_id").agg(ordered.alias("contradictions"))


def replace_partition(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert of whole groups: rows of ``current`` whose ``key`` is not in ``new``, then ``new``."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
