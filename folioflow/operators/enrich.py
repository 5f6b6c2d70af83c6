"""Enrichment of chunks, summaries, tables and what is written at the end."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import automaton
from ..functions.text import page_numbers, strip
from ..plans.staging import stage


def merge_metadata(chunks: DataFrame, *sources: DataFrame, keys: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """Adds each source's columns by chunk_id; a value that is there wins over what the chunk had.

    With ``keys`` of a document and a place in it, sources are merged by position.
    """
    out = chunks
    for s in sources:
        names = [c for c in s.columns if c not in keys]
        renamed = s.select(*keys, *[F.col(c).alias(f"__{c}") for c in names])
        out = out.join(renamed, list(keys), "left")
        for c in names:
            out = out.withColumn(c, F.coalesce(f"__{c}", c) if c in out.columns else F.col(f"__{c}"))
        out = out.drop(*[f"__{c}" for c in names])
    return out


def index_points(chunks: DataFrame) -> DataFrame:
    """point_type, id, text: sub-chunks where there are any, else the chunk; questions of chunks; parents of sub-chunks.

    ``chunks``: chunk_id, text, questions, sub_chunks array<struct<chunk_id, text>>.
    """
    has_subs = F.coalesce(F.size("sub_chunks") > 0, F.lit(False))
    whole = chunks.where(~has_subs).select(F.lit("chunk").alias("point_type"), F.col("chunk_id").alias("id"), "text")
    subs = chunks.where(has_subs).select(F.explode("sub_chunks").alias("s")).select(F.lit("chunk").alias("point_type"), F.col("s.chunk_id").alias("id"), F.col("s.text").alias("text"))
    parents = chunks.where(has_subs).select(F.lit("parent_chunk").alias("point_type"), F.col("chunk_id").alias("id"), "text")
    asked = chunks.select("chunk_id", F.posexplode("questions").alias("n", "text"))
    asked = asked.select(F.lit("question").alias("point_type"), F.concat_ws("#", "chunk_id", "n").alias("id"), "text")
    return whole.unionByName(subs).unionByName(parents).unionByName(asked)


def upsert_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries by document_name: the new one wins in the old one's place; durations add."""
    n = new.select("document_name", F.col("summary").alias("s2"), F.col("duration").alias("d2"), F.col("pos").alias("p2"))
    last = old.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("top"))
    joined = old.join(n, "document_name", "full_outer").join(F.broadcast(last))
    return joined.select(
        "document_name",
        F.coalesce("s2", "summary").alias("summary"),
        (F.coalesce("duration", F.lit(0)) + F.coalesce("d2", F.lit(0))).alias("duration"),
        F.coalesce(F.col("pos"), F.col("top") + 1 + F.col("p2")).alias("pos"),
    )


def join_in_blocks(parts: DataFrame, *, size: int = 4, most: int = 10_000, condense: Callable[[Column], Column] | None = None) -> DataFrame:
    """document_id, text: a document's parts joined four by four until they fit ``most`` characters or are one.

    Each round is one grouping of all documents that are not done; a document leaves with the round it fits.
    ``condense`` is applied to every block that a round joins (a model's summary of it).
    """
    now = parts.select("document_id", "pos", "text")
    done = None
    while True:
        w = Window.partitionBy("document_id")
        sized = now.withColumn("n", F.count("*").over(w)).withColumn("size", F.sum(F.length("text")).over(w))
        sized = stage(sized, "summary-round")
        fits = sized.where((F.col("n") == 1) | (F.col("size") <= most)).select("document_id", "pos", "text")
        done = fits if done is None else done.unionByName(fits)
        rest = sized.where((F.col("n") > 1) & (F.col("size") > most))
        if rest.isEmpty():
            break
        now = _joined(rest.withColumn("block", F.floor(F.col("pos") / size)), "document_id", "block").withColumnRenamed("block", "pos")
        if condense is not None:
            now = now.withColumn("text", condense(F.col("text")))
    return _joined(done, "document_id")


def _joined(rows: DataFrame, *keys: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def furniture_tables(cells: DataFrame, furniture: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id, table_id of tables most non-empty cells of which are part of a furniture text of the document.

    A document's distinct cells are looked for in its distinct furniture texts all at once, one pass over each text;
    documents without furniture texts are left out before.
    """
    texts = furniture.where(F.col("text") != "").groupBy("doc_id").agg(F.collect_set("text").alias("texts"))
    full = cells.where(strip(F.coalesce("cell", F.lit(""))) != "").select("doc_id", "table_id", "cell")
    distinct = full.groupBy("doc_id").agg(F.collect_set("cell").alias("cells")).join(texts, "doc_id")

    @F.pandas_udf("array<string>")
    def inside(lists: pd.Series, held: pd.Series) -> pd.Series:
        def one(strings, texts) -> list[str]:
            search = automaton(strings)
            return sorted({s for t in texts for _, s in search.iter(t)}) if search else []

        return pd.Series([one(a, b) for a, b in zip(lists, held, strict=True)])

    known = distinct.select("doc_id", F.explode(inside("cells", "texts")).alias("cell"), F.lit(1.0).alias("__in"))
    rated = full.join(texts.select("doc_id"), "doc_id", "left_semi").join(known, ["doc_id", "cell"], "left")
    return rated.groupBy("doc_id", "table_id").agg(F.avg(F.coalesce("__in", F.lit(0.0))).alias("r")).where(F.col("r") > share).select("doc_id", "table_id")


def escape_html(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def grid_html(cells: DataFrame) -> DataFrame:
    """table_id, html from cells (row, col, row_span, col_span, header, text); missing ones are empty, covered ones left out."""
    size = cells.groupBy("table_id").agg(F.max(F.col("row") + F.col("row_span")).alias("rows"), F.max(F.col("col") + F.col("col_span")).alias("cols"))
    at = size.select("table_id", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "cols")
    at = at.select("table_id", "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    covered = cells.select("table_id", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("r"), F.col("row").alias("r0"), F.col("col").alias("c0"), "col_span")
    covered = covered.select("table_id", F.col("r").alias("row"), F.explode(F.sequence(F.col("c0"), F.col("c0") + F.col("col_span") - 1)).alias("col"), "r0", "c0")
    covered = covered.where((F.col("row") != F.col("r0")) | (F.col("col") != F.col("c0"))).select("table_id", "row", "col").distinct()
    tag = F.when(F.col("header"), "th").otherwise("td")
    span = lambda name: F.when(F.col(f"{name}_span") > 1, F.concat(F.lit(f' {name}span="'), F.col(f"{name}_span").cast("string"), F.lit('"'))).otherwise("")
    html = F.concat(F.lit("<"), tag, span("row"), span("col"), F.lit(">"), escape_html(F.coalesce("text", F.lit(""))), F.lit("</"), tag, F.lit(">"))
    drawn = cells.select("table_id", "row", "col", html.alias("html"))
    all_cells = at.join(covered, ["table_id", "row", "col"], "left_anti").join(drawn, ["table_id", "row", "col"], "left")
    lines = all_cells.groupBy("table_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("html", F.lit("<td></td>")).alias("h")))).alias("c"))
    line = F.concat(F.lit("<tr>"), F.array_join(F.transform("c", lambda x: x["h"]), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("l")))), lambda x: x["l"]), "")
    return lines.groupBy("table_id").agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))


def top_questions(questions: Column, most: int = 3) -> Column:
    return F.slice(F.filter(F.transform(questions, strip), lambda q: q != ""), 1, most)


def topic_names(chunks: DataFrame, topics: DataFrame) -> DataFrame:
    """Adds topic_name by topic_id: -1 is unsure, unknown ids are invalid."""
    names = topics.select("topic_id", F.col("name").alias("__name"))
    known = F.when(F.col("topic_id") == -1, "Unsicher").otherwise(F.coalesce("__name", F.lit("Invalid ID")))
    return chunks.join(names, "topic_id", "left").withColumn("topic_name", known).drop("__name")


def last_page(markdown: Column) -> Column:
    return F.array_max(page_numbers(markdown))


def eligible_chunks(chunks: DataFrame, least: int = 50) -> DataFrame:
    return chunks.where((F.length("text") >= least) & (F.col("chunk_type") != "image"))


def subtree_tokens(nodes: DataFrame) -> DataFrame:
    """Adds total_tokens: a heading's own tokens and those below it (the next heading of its level or a higher one ends it).

    ``nodes``: doc_id, line, level, tokens.  Running sums and, per level, the next line that ends it; no self join.
    """
    order = Window.partitionBy("doc_id").orderBy("line")
    # what follows is what precedes in falling order: a frame that ends with the document would be read anew for every row
    after = Window.partitionBy("doc_id").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumn("__before", F.sum("tokens").over(order) - F.col("tokens")).withColumn("__all", F.sum("tokens").over(Window.partitionBy("doc_id")))
    ends = [F.when(F.col("level") >= k, F.min(F.when(F.col("level") == k, F.struct("line", "__before"))).over(after)) for k in range(1, 7)]
    out = out.withColumn("__end", F.least(*ends))
    return out.withColumn("total_tokens", F.coalesce("__end.__before", "__all") - F.col("__before")).drop("__before", "__all", "__end")
