"""Heading trees as tables: subtree ends, thinning, pages of nodes, summaries, numbered tables of contents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bound, strip
from ..plans.staging import stage
from .chunks import page_parts
from .enrich import join_in_blocks
from .graph import root_paths

#: Marks of pages as nodes and chunks know them; a numbered heading; a line that may be one, with or without ``#``.
NODE_PAGE = r'<seite\s+nummer="(\d+)"\s*/?>'
NUMBERED = r"^([\d.]+)\s+(.*)"
NUMBERED_LINE = r"(?<![^\n])(?:#+[ \t\x0B\f\r]*)?[\d.]+[ \t\x0B\f\r][^\n]*"
ROOT = "_DOCUMENT_ROOT_"
#: A document's contents in the order of the tree.
TITLES = "array<struct<key:array<int>,ord:int,title:string,path:array<string>>>"


def subtree_ends(nodes: DataFrame, levels: int = 6) -> DataFrame:
    """Adds ``end``: the line of the next heading of the node's level or a higher one, null at the end of the document.

    ``nodes``: doc_id, line, level.  Per level a running minimum in falling order of lines, so a document's headings are
    read once; a frame that ends with the document would be read anew for every row.
    """
    after = Window.partitionBy("doc_id").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.when(F.col("level") >= k, F.min(F.when(F.col("level") == k, F.col("line"))).over(after)) for k in range(1, levels + 1)]
    return nodes.withColumn("end", F.least(*ends))


def own_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (doc_id, line, …) with ``text``: the trimmed lines from the heading to the next one.  ``docs``: doc_id, markdown."""
    lines = docs.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "row"))
    heads = nodes.select("doc_id", (F.col("line") - 1).alias("pos"), "line")
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.join(heads, ["doc_id", "pos"], "left").withColumn("line", F.last("line", ignorenulls=True).over(order)).where("line is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda x: x["row"]), "\n")
    return nodes.join(held.groupBy("doc_id", "line").agg(strip(text).alias("text")), ["doc_id", "line"])


def thinned(nodes: DataFrame, least: int) -> DataFrame:
    """Nodes whose subtree holds fewer than ``least`` tokens take in all below them; doc_id, line, level, text of those that stay.

    ``nodes``: doc_id, line, level, text, total_tokens (of the subtree).  Subtrees are nested or apart, so a node goes
    exactly if a small subtree that began before it has not ended yet; its text goes to the last node that stays.
    """
    order = Window.partitionBy("doc_id").orderBy("line")
    open_end = F.coalesce("end", F.lit((1 << 31) - 1))
    reach = F.max(F.when(F.col("total_tokens") < least, open_end)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = subtree_ends(nodes).withColumn("__stays", F.coalesce(reach, F.lit(0)) <= F.col("line"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("__owner", F.last(F.when(F.col("__stays"), F.col("line")), ignorenulls=True).over(so_far))
    filled = F.when(F.col("__stays") | (strip(F.col("text")) != ""), F.struct("line", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(filled)), lambda x: x["text"]), "\n\n")
    return marked.groupBy("doc_id", F.col("__owner").alias("line")).agg(F.max(F.when(F.col("__stays"), F.col("level"))).alias("level"), text.alias("text"))


def node_pages(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, line, pages of each node: those whose range meets the node's, ends included; null without any mark.

    A node reaches from the end of its heading's line to the end of the next heading's; the last to the last mark.  A
    heading in the last line has no range and no pages.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "row"))
    up_to = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # position of the line end after each line but the last
    ends = lines.select("doc_id", (F.col("pos") + 1).alias("line"), (F.sum(F.length("row") + 1).over(up_to) - 1).alias("at"), F.lead("pos").over(Window.partitionBy("doc_id").orderBy("pos")).alias("more"))
    ends = ends.where("more is not null").select("doc_id", "line", "at")
    marks = F.regexp_extract_all("markdown", F.lit(NODE_PAGE), F.lit(0))
    numbers = F.regexp_extract_all("markdown", F.lit(NODE_PAGE), F.lit(1))
    gaps = F.slice(F.split("markdown", NODE_PAGE, -1), F.lit(1), F.size(marks))
    found = docs.select("doc_id", F.length("markdown").alias("n"), F.posexplode(F.arrays_zip(gaps.alias("gap"), marks.alias("mark"), numbers.alias("page"))).alias("pos", "m"))
    pages = found.select("doc_id", "n", "pos", F.col("m.page").cast("int").alias("page"), (F.sum(F.length("m.gap") + F.length("m.mark")).over(up_to) - F.length("m.mark")).alias("start"))
    pages = pages.withColumn("stop", F.coalesce(F.lead("start").over(Window.partitionBy("doc_id").orderBy("pos")), "n"))
    last = pages.groupBy("doc_id").agg((F.max("start") + 1).alias("__last"))
    own = nodes.select("doc_id", "line", F.lead("line").over(Window.partitionBy("doc_id").orderBy("line")).alias("__next"))
    own = own.join(ends.withColumnRenamed("at", "__from"), ["doc_id", "line"], "left")
    own = own.join(ends.select("doc_id", F.col("line").alias("__next"), F.col("at").alias("__to")), ["doc_id", "__next"], "left")
    own = own.join(last, "doc_id", "left").withColumn("__to", F.coalesce("__to", "__last"))
    met = own.join(pages, "doc_id").where((F.col("start") <= F.col("__to")) & (F.col("stop") >= F.col("__from")))
    listed = met.groupBy("doc_id", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "page"))), lambda x: x["page"]).alias("pages"))
    out = own.join(listed, ["doc_id", "line"], "left")
    return out.select("doc_id", "line", F.when(F.col("__last").isNotNull(), F.coalesce("pages", F.array().cast("array<int>"))).alias("pages"))


def node_summaries(nodes: DataFrame, summarize: Callable[[Column], Column], least: int = 200) -> DataFrame:
    """``nodes`` (doc_id, line, parent, text, tokens) with summary (leaves) and prefix_summary (others): short texts are their own."""
    inner = nodes.where("parent is not null").select("doc_id", F.col("parent").alias("line")).distinct().withColumn("__inner", F.lit(True))
    short = F.col("tokens") < least
    said = F.when(short, F.col("text")).otherwise(summarize(F.when(~short, F.col("text"))))
    out = nodes.join(inner, ["doc_id", "line"], "left").withColumn("__said", said)
    leaf = F.col("__inner").isNull()
    return out.withColumn("summary", F.when(leaf, F.col("__said"))).withColumn("prefix_summary", F.when(~leaf, F.col("__said"))).drop("__inner", "__said")


# Numbered tables of contents


def numbered_headings(items: DataFrame) -> DataFrame:
    """doc_id, pos, title, level of items (doc_id, pos, type, text_level, text) of the first level that begin with a number."""
    text = strip(F.col("text"))
    number = F.regexp_replace(F.regexp_extract(text, NUMBERED, 1), r"^\.+|\.+$", "")
    rows = items.where((F.col("type") == "text") & (F.col("text_level") == 1) & text.rlike(NUMBERED))
    return rows.select("doc_id", "pos", text.alias("title"), F.size(F.split(number, r"\.")).alias("level"))


def contents_parents(headings: DataFrame) -> DataFrame:
    """doc_id, title, ord, parent: the nearest earlier heading of a smaller depth; a title that repeats has its first place and last parent.

    A document's headings pass once, in order, over a stack of those still open; numbers may be of any depth.
    """
    kinds = {f.name: f.dataType.simpleString() for f in headings.schema}
    rows = headings.select("doc_id", "pos", "level", "title").repartition("doc_id").sortWithinPartitions("doc_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, open_ = None, []
        for batch in batches:
            found = []
            for d, level, title in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if d != doc:
                    doc, open_ = d, []
                while open_ and open_[-1][0] >= level:
                    open_.pop()
                found.append(open_[-1][1] if open_ else ROOT)
                open_.append((level, title))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(found, pa.string())], names=["doc_id", "pos", "title", "parent"])

    found = rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, pos {kinds['pos']}, title string, parent string")
    return found.groupBy("doc_id", "title").agg(F.min("pos").alias("ord"), F.max_by("parent", "pos").alias("parent"))


def contents_paths(parents: DataFrame) -> DataFrame:
    """doc_id, title, ord, path (titles from the top down to this one) and key (their places), for trees of any depth.

    Titles whose parents lead in a circle (repeated titles can do that) are not below the root and have no path.
    """
    up = F.when(F.col("parent") != ROOT, F.col("parent"))
    links = parents.select("doc_id", F.col("title").alias("node"), up.alias("up"), "ord", F.array("title").alias("path"), F.array("ord").alias("key"))
    return root_paths(links, ["doc_id"], ["path", "key"]).select("doc_id", F.col("node").alias("title"), "ord", "path", "key")


def contents_lists(paths: DataFrame) -> DataFrame:
    """doc_id, titles: a document's ``paths`` (see :func:`contents_paths`) as one list in the order of the tree."""
    listed = F.array_sort(F.collect_list(F.struct("key", "ord", "title", "path")))
    return paths.groupBy("doc_id").agg(listed.cast(TITLES).alias("titles"))


def latest_titles(texts: Column, titles: Column) -> Column:
    """For each of a document's texts the place in ``titles`` of its own heading, else its predecessor's, else -1.

    A text's heading is the last title (in order of the contents) that is a line of it, with or without ``#``.
    """
    raw = lambda line: F.regexp_replace(line, r"\s+$", "")
    both = lambda line: F.array(F.regexp_replace(raw(line), r"^#+\s*", ""), raw(line))
    lines = lambda text: F.flatten(F.transform(F.regexp_extract_all(text, F.lit(NUMBERED_LINE), F.lit(0)), both))
    last = lambda named: F.array_max(F.filter(F.transform(titles, lambda t, i: F.when(F.array_contains(named, t["title"]), F.struct(t["ord"], i.alias("i")))), lambda x: x.isNotNull()))["i"]
    own = F.transform(texts, lambda text: bound(lines(text), lambda named: F.when(F.size(named) > 0, last(named))))

    def filled(own: Column) -> Column:
        places = F.concat(F.array(F.lit(-1)), F.filter(F.transform(own, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull()))
        run = lambda at, k, places: F.array_repeat(F.coalesce(F.get(own, at), F.lit(-1)), F.coalesce(F.get(places, k + 1), F.size(own)) - F.greatest(at, F.lit(0)))
        return bound(places, lambda places: F.flatten(F.transform(places, lambda at, k: run(at, k, places))))

    return bound(own, filled)


def title_paths(titles: Column, place: Column) -> tuple[Column, Column]:
    """The path of the title at a place, and the path's first title with all below it; empty for -1."""
    none, path = F.array().cast("array<string>"), F.get(titles, place)["path"]
    below = bound(F.get(path, F.lit(0)), lambda top: F.transform(F.filter(titles, lambda t: F.get(t["path"], F.lit(0)) == top), lambda t: t["title"]))
    return F.coalesce(path, none), F.when(path.isNotNull(), below).otherwise(none)


def chunk_paths(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_id, chunk, toc_path, all_subchapters; a chunk without a heading has its predecessor's.

    ``chunks``: doc_id, chunk, text; ``paths``: see :func:`contents_paths`, of numbered titles.  all_subchapters is the
    path's first title and all below it, in the order of the tree.
    """
    rows = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("chunks"))
    rows = rows.join(contents_lists(paths), "doc_id", "left")
    rows = rows.withColumn("owners", latest_titles(F.transform("chunks", lambda c: c["text"]), F.col("titles")))
    listed = F.arrays_zip(F.transform("chunks", lambda c: c["chunk"]).alias("chunk"), F.col("owners").alias("owner"))
    each = rows.select("doc_id", "titles", F.explode(listed).alias("x")).select("doc_id", "titles", "x.*")
    path, below = title_paths(F.col("titles"), F.col("owner"))
    return each.select("doc_id", "chunk", path.alias("toc_path"), below.alias("all_subchapters"))


# Nested trees


def nested_tree(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id, tree of ``nodes`` (doc_id, line, parent, fields): each document's tree as JSON, children inside ``nodes`` in order of their lines.

    An object has its ``fields`` in that order, null ones left out, and ``nodes`` if it has any children.  Every row knows its
    path of lines from the root, so a document's objects are sorted once in pre-order, and what stands between two of them
    follows from the depths of both: the tree is one string for each document without a join for each level.  Nodes whose
    parent is not there have no place and are dropped.
    """
    links = nodes.select("doc_id", F.col("line").alias("node"), F.col("parent").alias("up"), F.array("line").alias("place"), F.to_json(F.struct(*fields)).alias("__object"))
    placed = root_paths(links, ["doc_id"], ["place"])
    order = Window.partitionBy("doc_id").orderBy("place")
    depth, after = F.size("place"), F.lead(F.size("place")).over(order)
    bare = F.col("__object") == "{}"
    head = F.expr("substring(__object, 1, length(__object) - 1)")
    opened = F.concat(head, F.when(bare, "").otherwise(","), F.lit('"nodes":['))
    closed = F.concat(F.col("__object"), F.repeat(F.lit("]}"), depth - F.coalesce(after, F.lit(1))), F.when(after.isNotNull(), ",").otherwise(""))
    written = placed.select("doc_id", "place", F.when(after > depth, opened).otherwise(closed).alias("part"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"])
    return written.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(listed, ""), F.lit("]")).alias("tree"))


def flat_tree(trees: DataFrame, fields: str) -> DataFrame:
    """doc_id, place and ``fields`` (a DDL list) of every object of ``trees`` (doc_id, tree), depth first: the reverse of :func:`nested_tree`.

    ``place`` is the path of positions among siblings.  A step goes down one level for all documents, as a level's objects
    must be read to know the next one's; it ends with the deepest tree.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    parse = lambda c: F.from_json(c, f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}, nodes:string>>")
    step = trees.select("doc_id", F.array().cast("array<int>").alias("place"), F.col("tree").alias("nodes"))
    out = None
    while True:
        below = step.where("nodes is not null").select("doc_id", "place", F.posexplode(parse(F.col("nodes"))).alias("at", "o"))
        step = stage(below.select("doc_id", F.concat("place", F.array("at")).alias("place"), *[f"o.{n}" for n in names], "o.nodes"), "flat")
        if step.isEmpty():
            break
        found = step.drop("nodes")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else step.drop("nodes")


# Summaries over pages


def part_summaries(parts: DataFrame, summarize: Callable[[Column], Column], condense: Callable[[Column], Column], *, most: int = 10_000, limit: int = 3000) -> DataFrame:
    """document_id, summary from parts (document_id, pos, text): each summarized, joined in fours until they fit, condensed if over ``limit``."""
    said = parts.select("document_id", "pos", summarize(F.col("text")).alias("text"))
    joined = join_in_blocks(said, most=most)
    long = F.length("text") > limit
    return joined.select("document_id", F.when(long, condense(F.when(long, F.col("text")))).otherwise(F.col("text")).alias("summary"))


def document_summaries(docs: DataFrame, summarize: Callable[[Column], Column], condense: Callable[[Column], Column], *, batch: int = 25, group: int = 8, limit: int = 3000, part_limit: int = 3000) -> DataFrame:
    """document_id, summary of ``docs`` (doc_id, markdown): pages in batches of 25, a summary each, joined; no pages give a blank one.

    Blank summaries are dropped, one stands as it is, several are joined by line ends and condensed if over ``limit``;
    ``part_limit`` is the limit of a batch.
    """
    pages = docs.select("doc_id", F.posexplode(page_parts(F.col("markdown"), 1)).alias("page", "text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    batches = pages.groupBy("doc_id", F.floor(F.col("page") / batch).cast("int").alias("batch")).agg(F.array_join(ordered, "\n").alias("text"))
    key = F.struct("doc_id", "batch")
    parts = batches.select(key.alias("document_id"), F.posexplode(page_parts(F.col("text"), group)).alias("pos", "text"))
    done = part_summaries(parts, summarize, condense, limit=part_limit).select("document_id.*", "summary").where("summary <> ''")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("batch", "summary"))), lambda x: x["summary"])
    all_ = done.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(listed, "\n").alias("text"))
    long = (F.col("n") > 1) & (F.length("text") > limit)
    told = all_.select("doc_id", F.when(long, condense(F.when(long, F.col("text")))).otherwise(F.col("text")).alias("summary"))
    return docs.select("doc_id").join(told, "doc_id", "left").select(F.col("doc_id").alias("document_id"), F.coalesce("summary", F.lit("")).alias("summary"))
