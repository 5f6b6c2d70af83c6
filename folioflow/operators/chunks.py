"""Chunks and headings of markdown: sections, pages, links between chunks, merging, splitting, trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import PAGE_MARK, PAGE_TAG, page_numbers
from .folds import oversized_parts


def links(chunks: DataFrame) -> DataFrame:
    """Ids of the previous and next chunk of a document."""
    w = Window.partitionBy("document_id").orderBy("seq")
    return chunks.withColumn("previous_chunk_id", F.lag("chunk_id").over(w)).withColumn("next_chunk_id", F.lead("chunk_id").over(w))


def related_assets(chunks: DataFrame) -> DataFrame:
    """Adjacent sub-chunks of unlike kind (text beside no text) as (chunk_id, related_id)."""
    w = Window.partitionBy("document_id").orderBy("seq")
    out = None
    for move in (F.lag, F.lead):
        near = chunks.select("chunk_id", F.col("chunk_type"), move(F.struct("chunk_id", "chunk_type")).over(w).alias("n"))
        near = near.where(F.col("n").isNotNull() & ((F.col("chunk_type") == "text") != (F.col("n.chunk_type") == "text")))
        near = near.select("chunk_id", F.col("n.chunk_id").alias("related_id"))
        out = near if out is None else out.unionByName(near)
    return out


def batches(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Number of the batch of ``size`` rows that each row is in."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def header_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, line (1-based), level, title of markdown headings; indented ones are none."""
    lines = docs.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "text"))
    level = F.length(F.regexp_extract("text", r"^(#{1,6})\s+\S", 1))
    return lines.where(level > 0).select(
        "doc_id", (F.col("pos") + 1).alias("line"), level.alias("level"), F.regexp_replace("text", r"^#{1,6}\s+|\s+$", "").alias("title")
    )


def heading_parents(nodes: DataFrame) -> DataFrame:
    """Adds ``parent``: the line of the nearest earlier heading of a smaller level.

    Per level a running maximum over the document; no join of headings with each other.
    """
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    out = nodes
    for k in range(1, 7):
        out = out.withColumn(f"__l{k}", F.max(F.when(F.col("level") == k, F.col("line"))).over(w))
    smaller = [F.when(F.col("level") > k, F.col(f"__l{k}")) for k in range(1, 7)]
    return out.withColumn("parent", F.greatest(*smaller)).drop(*[f"__l{k}" for k in range(1, 7)])


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, h1, h2, text: markdown cut at # and ##; ## inherits the last #, # clears ##."""
    lines = docs.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "line"))
    head = F.regexp_extract("line", r"^(##?)\s+(.*)$", 1)
    title = F.trim(F.regexp_extract("line", r"^(##?)\s+(.*)$", 2))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("is_head", (head != "").cast("int")).withColumn("t1", F.when(head == "#", title))
    out = out.withColumn("section", F.sum("is_head").over(w)).withColumn("h1", F.last("t1", ignorenulls=True).over(w))
    # "" marks the reset that a # brings
    out = out.withColumn("t2", F.when(head == "#", F.lit("")).when(head == "##", title)).withColumn("h2", F.nullif(F.last("t2", ignorenulls=True).over(w), F.lit("")))
    return out.groupBy("doc_id", "section").agg(
        F.max("h1").alias("h1"),
        F.max("h2").alias("h2"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )


def node_text_ranges(nodes: DataFrame, n_lines: Column) -> DataFrame:
    """Adds first and last line of each heading's own text."""
    after = F.lead("line").over(Window.partitionBy("doc_id").orderBy("line"))
    return nodes.withColumn("last_line", F.coalesce(after - 1, n_lines))


def fill_forward(chunks: DataFrame, column: str) -> DataFrame:
    """Adds ``resolved``: the last value of ``column`` so far that is not null."""
    w = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("resolved", F.last(column, ignorenulls=True).over(w))


def page_parts(markdown: Column, group: int = 5, most: int = 80_000) -> Column:
    """Texts of ``group`` pages each, marks included, cut where they exceed ``most`` characters.

    What stands before the first mark is dropped, no mark gives none.
    """
    pages = F.split(markdown, f"(?={PAGE_TAG})", -1)
    pages = F.filter(pages, lambda p: p.rlike("^" + PAGE_TAG))
    n = F.ceil(F.size(pages) / F.lit(group)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(pages, i * group + 1, F.lit(group)), ""))
    return oversized_parts(most)(F.when(F.size(pages) > 0, parts).otherwise(F.array().cast("array<string>")))


def page_of_chunks(chunks: DataFrame) -> DataFrame:
    """Adds the sorted pages of each chunk: the page it begins on (carried, unless a mark leads it) and its marks."""
    w = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    marks = page_numbers(F.col("text"))
    out = chunks.withColumn("__m", marks).withColumn("__top", F.max(F.array_max("__m")).over(w))
    leads = F.col("text").rlike(r"^\s*" + PAGE_MARK)
    carried = F.when(leads, F.array().cast("array<int>")).otherwise(F.array(F.coalesce("__top", F.lit(1))))
    return out.withColumn("page_numbers", F.array_sort(F.array_distinct(F.concat(carried, "__m")))).drop("__m", "__top")


def connected_run(rows: DataFrame, flag: str) -> DataFrame:
    """Rows of each document from its start up to the last before the first false ``flag``."""
    w = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__run", F.min(F.col(flag).cast("int")).over(w)).where("__run = 1").drop("__run")


def first_positive(rows: DataFrame, flag: str) -> DataFrame:
    return rows.where(F.col(flag)).groupBy("document_id").agg(F.min("seq").alias("seq"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _full_runs(lengths: pd.Series, least: pd.Series) -> pd.Series:
    """Where each run of items starts: a run ends where its sum reaches ``least``; what is left over joins the last run."""

    def one(sizes, least: int) -> list[int]:
        starts, total = [0] if len(sizes) else [], 0
        for i, n in enumerate(sizes):
            total += n
            if total >= least:
                starts.append(i + 1)
                total = 0
        if len(starts) > 1:
            starts.pop()  # the end of the last full run: nothing, or a rest, follows it
        return starts

    return pd.Series([one(s, k) for s, k in zip(lengths, least, strict=True)])


def merge_small(chunks: DataFrame, least: int = 800) -> DataFrame:
    """document_id, part, text, n_chunks: chunks joined in order until ``least`` characters; the rest joins the last.

    The sum starts anew at every cut, so the lengths of a document's chunks (not the texts) go through a fold.  A run is
    joined before runs become rows: each text is copied once, however many runs its document has.  Null texts add
    nothing to a run but count as chunks of it.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    rows = chunks.groupBy("document_id").agg(ordered.alias("texts"))
    sizes = F.transform("texts", lambda t: F.coalesce(F.length(t), F.lit(0)))
    rows = rows.withColumn("starts", _full_runs(sizes, F.lit(least)))
    size = lambda start, i: F.coalesce(F.get("starts", i + 1), F.size("texts")) - start
    joined = F.transform("starts", lambda start, i: F.struct(F.array_join(F.slice("texts", start + 1, size(start, i)), "\n").alias("text"), size(start, i).alias("n_chunks")))
    out = rows.select("document_id", F.posexplode(joined).alias("part", "run"))
    return out.select("document_id", "part", "run.text", "run.n_chunks")


def around(lines: DataFrame, anchor: DataFrame, n: int = 10) -> DataFrame:
    """Trimmed, non-blank lines within ``n`` of the first line with each anchor; the anchor's line is left out."""
    near = anchor.select(F.col("doc_id").alias("d"), F.explode(F.sequence(F.col("pos") - n, F.col("pos") + n)).alias("p"), F.col("pos").alias("at"))
    out = lines.join(near, (F.col("doc_id") == F.col("d")) & (F.col("pos") == F.col("p"))).where("p <> at")
    return out.where(F.trim("line") != "").groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.trim("line").alias("t")))), lambda x: x["t"]), "\n").alias("context")
    )
