"""Markdown of whole documents: the chunker, page marks, removals, replacements, joined parts.

What the chunker needs in a document's order (sections, parents, pages) are lists inside its row, so a text is never
sorted or joined; Python sees one text at a time and only where a regular expression must move on from its last match.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.batches import text_column
from ..functions.html import parsed
from ..functions.patterns import leftmost_longest, places
from ..functions.text import bound, fix_mojibake, strip, without_numbering
from .folds import split_lists, split_text
from .tree import TITLES, contents_lists, contents_parents, contents_paths, latest_titles, numbered_headings, title_paths

#: Elements that no cut may go through, marks of pages, placeholders, limits in characters.
ISOLATED = r"(?is)(<BILD.*?/BILD>|<TABELLE.*?/TABELLE>|<table\b[^>]*>.*?</table>)"
ELEMENT = r'(?is)<BILD\s+img_path="[^"]*">.*?</BILD>|<TABELLE\s+img_path="[^"]*">.*?</TABELLE>|<table\b[^>]*>.*?</table>'
FIELDS = {"caption": "caption_text", "summary": "summary", "description": "description", "footnote": "footnote_text"}
TABLE_BODY, TABLE_MARK = r"(?is)<tbody[^>]*>(.*)</tbody>", r"(?is)</?table[^>]*>"
PAGE = r'<seite nummer="(\d+)"\s*/>'
PART_PAGE = r'<seite nummer="(\d+)" />'
PLACEHOLDER = "__SPECIAL_ELEMENT_PLACEHOLDER_%s__"
SECTION_HEAD = r"^\s*(##?) (.*)$"
#: The line ends before headings of the first level, and of the second, as SECTION_HEAD finds them.
FIRST_CUT, SECOND_CUT = (r"\n(?=[ \t\x0B\f\r]*%s [^\n\r\u0085\u2028\u2029]*[\r\u0085\u2028\u2029]?(?![^\n]))" % mark for mark in ("#", "##"))
IMAGE_PATH = r'(<(?:BILD|TABELLE)) img_path="[^"]*"'
SUB_CHUNK, PARENT_CHUNK = 2000, 30_000


# The chunker, step by step


def _placeholders(markdown: Column) -> tuple[Column, Column]:
    """A text's elements, and the text with numbered placeholders for them."""
    found, gaps = F.regexp_extract_all(markdown, F.lit(ISOLATED), F.lit(1)), F.split(markdown, ISOLATED, -1)
    key = lambda i: F.concat(F.lit("\n\n"), F.format_string(PLACEHOLDER, i.cast("string")), F.lit("\n\n"))
    return found, F.array_join(F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(key(i - 1), g))), "")


def isolated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, markdown) with elements replaced by numbered placeholders, and the elements: doc_id, number, element."""
    found, body = _placeholders(F.col("markdown"))
    return docs.select("doc_id", body.alias("markdown")), docs.select("doc_id", F.posexplode(found).alias("number", "element"))


def _named_elements(text: Column, elements: Column) -> Column:
    """The elements that a text's placeholders name, in their order; "" for a number that there is none of."""
    numbers = F.regexp_extract_all(text, F.lit(PLACEHOLDER % r"(\d+)"), F.lit(1))
    return F.transform(numbers, lambda n: F.coalesce(F.get(elements, n.try_cast("int")), F.lit("")))


def _section_list(markdown: Column, elements: Column | None = None) -> Column:
    """Sections of a text as a list of h1, h2, text (trimmed) and the elements of its placeholders; blank ones too."""
    line = lambda t: F.substring_index(t, "\n", 1)
    title = lambda t, mark: F.when(F.regexp_extract(line(t), SECTION_HEAD, 1) == mark, strip(F.regexp_extract(line(t), SECTION_HEAD, 2)))
    held = lambda t: [] if elements is None else [_named_elements(t, elements).alias("elements")]
    part = lambda first, t: F.struct(title(first, "#").alias("h1"), title(t, "##").alias("h2"), strip(t).alias("text"), *held(t))
    return F.flatten(F.transform(F.split(markdown, FIRST_CUT, -1), lambda first: F.transform(F.split(first, SECOND_CUT, -1), lambda t: part(first, t))))


def header_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, h1, h2, text: cut before lines that begin with one or two ``#``; the second level ends with the first.

    Texts are trimmed, blank sections left out.
    """
    # what stands before the first heading is section 0
    first = (F.regexp_extract(F.substring_index("markdown", "\n", 1), SECTION_HEAD, 1) != "").cast("int")
    rows = docs.select("doc_id", first.alias("first"), F.posexplode(_section_list(F.col("markdown"))).alias("pos", "s"))
    return rows.select("doc_id", (F.col("pos") + F.col("first")).cast("long").alias("section"), "s.*").where("text <> ''")


def joined_to_next(rows: Column, moves: Callable[[Column, Column], Column]) -> Column:
    """Texts of a list's sections that ``moves`` marks put before the next one's, a blank line between; at the end, after the last that stays."""

    def joined(rows: Column) -> Column:
        n = F.size(rows)
        stays = F.filter(F.transform(rows, lambda r, i: F.when(~moves(r, i == n - 1), i)), lambda i: i.isNotNull())

        def one(at: Column, k: Column, stays: Column) -> Column:
            begin = F.coalesce(F.get(stays, k - 1) + 1, F.lit(0))
            end = F.when(k == F.size(stays) - 1, n).otherwise(at + 1)
            part, own = F.slice(rows, begin + 1, end - begin), F.get(rows, at)
            text = F.array_join(F.transform(part, lambda r: r["text"]), "\n\n")
            return F.struct(own["h1"].alias("h1"), own["h2"].alias("h2"), text.alias("text"), F.flatten(F.transform(part, lambda r: r["elements"])).alias("elements"))

        ends = lambda stays: F.when((F.size(stays) == 0) & (n > 0), F.array(n - 1)).otherwise(stays)
        return bound(stays, lambda found: bound(ends(found), lambda stays: F.transform(stays, lambda at, k: one(at, k, stays))))

    return bound(rows, joined)


def _without_marks(text: Column) -> Column:
    return F.regexp_replace(text, PAGE, "")


def merged_sections(sections: Column) -> Column:
    """Sections of nothing but placeholders join the next one; then those of nothing but headings do, the last ones the previous."""
    bare = lambda r: strip(F.regexp_replace(_without_marks(r["text"]), PLACEHOLDER % r"\d+", "")) == ""
    full = joined_to_next(sections, lambda r, last: bare(r) & ~last)
    return joined_to_next(full, lambda r, _: strip(F.regexp_replace(_without_marks(r["text"]), r"(?m)^#{1,6}\s+.*$", "")) == "")


def rehydrated(section: Column) -> Column:
    """A section's text with its ``elements`` back in place of the placeholders."""
    gaps = F.split(section["text"], PLACEHOLDER % r"\d+", -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.get(section["elements"], i - 1), g))), "")


def _with_parents(docs: DataFrame, most: int, overlap: int) -> DataFrame:
    """``docs`` with ``__parents``: a list of h1, h2, header, text: sections with their elements, cut where they exceed ``most``.

    A document is one row before and after: no part of it is sorted or sent.
    """
    others = [c for c in docs.columns if c != "markdown"]
    found, body = _placeholders(F.col("markdown"))
    held = docs.select(*others, body.alias("markdown"), found.alias("elements"))
    # the list is bound, as each section looks its elements up
    sections = bound(F.struct("markdown", "elements"), lambda d: F.filter(_section_list(d["markdown"], d["elements"]), lambda r: r["text"] != ""))
    row = lambda r: F.struct(r["h1"].alias("h1"), r["h2"].alias("h2"), without_numbering(F.coalesce(r["h2"], r["h1"])).alias("header"), rehydrated(r).alias("text"))
    whole = held.select(*others, F.transform(merged_sections(sections), row).alias("__whole"))
    long = F.transform("__whole", lambda r: F.when(F.length(r["text"]) > most, r["text"]))
    whole = whole.withColumn("__cut", split_lists(most, overlap)(F.when(F.exists("__whole", lambda r: F.length(r["text"]) > most), long)))
    one = lambda r, text: F.struct(r["h1"].alias("h1"), r["h2"].alias("h2"), r["header"].alias("header"), text.alias("text"))
    parts = lambda r, found: F.when(found.isNull(), F.array(one(r, r["text"]))).otherwise(F.transform(found, lambda text: one(r, text)))
    cut = bound(F.col("__cut"), lambda cut: F.transform("__whole", lambda r, i: parts(r, F.get(cut, i))))
    return whole.select(*others, F.flatten(cut).alias("__parents"))


def parent_chunks(docs: DataFrame, *, most: int = PARENT_CHUNK, overlap: int = 0) -> DataFrame:
    """doc_id, chunk (0-based), h1, h2, header, text: sections with their elements, cut where they exceed ``most``."""
    rows = _with_parents(docs.select("doc_id", "markdown"), most, overlap)
    # not the inner form, for which Spark would work the list out a second time to filter empty ones
    return rows.select("doc_id", F.posexplode_outer("__parents").alias("chunk", "p")).where("chunk is not null").select("doc_id", "chunk", "p.*")


def starting_pages(parents: Column) -> Column:
    """For each text of a document's list the first mark if nothing but blanks stands before it, else the highest page so far, at first 1."""
    marked = F.transform(parents, lambda p: F.struct(page_marks(p["text"]).alias("marks"), p["text"].rlike(r"^\s*" + PAGE).alias("leads")))
    top = lambda tops, m: F.concat(tops, F.array(F.greatest(F.get(tops, F.size(tops) - 1), F.array_max(m["marks"]))))

    def pages(marked: Column) -> Column:
        tops = lambda body: bound(F.aggregate(marked, F.array(F.lit(1)), top), body)
        return tops(lambda tops: F.transform(marked, lambda m, i: F.when(m["leads"], F.get(m["marks"], F.lit(0))).otherwise(F.get(tops, i))))

    return bound(marked, pages)


def page_marks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(PAGE), F.lit(1)), lambda x: x.cast("int"))


#: A sub-chunk: its text, kind, place in the parent, the page there (null before any mark) and an element's fields.
SUB = T.StructType().add("content", "string").add("chunk_type", "string").add("start", "integer").add("page", "integer")
ELEMENT_FIELDS = ("asset_path", "caption", "summary", "description", "body", "footnote")
for _name in ELEMENT_FIELDS:
    SUB = SUB.add(_name, "string")


def _tagged(tag: str, text: str) -> str:
    return f"<{tag}>{text}</{tag}>"


def element_fields(block: str) -> tuple[str, dict]:
    """Kind (bild, tabelle or "" for a bare table) and fields of an element; fields are its direct children."""
    tree = parsed(block)
    kind, owner = next(((k, e) for k in ("bild", "tabelle") if (e := tree.first(k))), ("", None))
    if owner is None:
        return kind, {"body": block.strip()}
    said = {k: owner.child(t) for k, t in FIELDS.items()}
    fields = {k: e.text().strip() if e else "" for k, e in said.items()}
    body = owner.child("content")
    return kind, fields | {"asset_path": owner.attributes.get("img_path", ""), "body": body.inner().strip() if body else ""}


def table_parts(html: str, most: int) -> list[str]:
    """A table's rows, as they are read, packed in order into tables of about ``most`` characters; one table where it has no rows."""
    body = re.search(TABLE_BODY, html)
    inside = body[1] if body else re.sub(TABLE_MARK, "", html).strip()
    groups: list[list[str]] = [[]]
    used = 0
    for row in (str(e) for e in parsed(inside).below() if e.name == "tr"):
        if used and used + len(row) > most:
            groups.append([])
            used = -1  # a new table begins without the line end that the first row has
        groups[-1].append(row)
        used += len(row) + 1
    texts = ["\n".join(g) for g in groups]
    # the first of several tables keeps the line end before its first row, the last one has none around it
    texts = ["\n" * (i == 0 and len(texts) > 1) + t for i, t in enumerate(texts)] if groups[0] else [inside]
    if groups[0]:
        texts[-1] = texts[-1].strip()
    return [f"<table>\n{t}\n</table>" for t in texts]


def _is_fragment(text: str) -> bool:
    low = text.strip().lower()
    return low.startswith(("<tr", "<td", "<th")) or sum(low.count(t) for t in ("<tr", "<td", "<th")) >= 2


def sub_chunks(text: str, size: int, overlap: int = 0) -> list[dict]:
    """Sub-chunks of a parent's text in order: segments between elements, then each element, whole or in parts."""
    marks = [(m.start(), int(m[1])) for m in re.finditer(PAGE, text)]
    out: list[dict] = []

    def add(content: str, kind: str, start: int, more: dict) -> None:
        page = next((p for at, p in reversed(marks) if at <= start), None)
        out.append({"content": content, "chunk_type": kind, "start": start, "page": page, **more})

    def segment(part: str, start: int) -> None:
        if part.strip():
            kind = "table" if _is_fragment(part) else "text"
            for piece in split_text(part, size, overlap) if len(part) > size else [part]:
                if re.sub(PAGE, "", piece).strip():
                    add(piece, kind, start, {})

    end = 0
    for m in re.finditer(ELEMENT, text):
        segment(text[end : m.start()], end)
        end = m.end()
        kind, known = element_fields(m[0])
        image = kind == "bild"
        tagged = {k: _tagged(t, known.get(k) or "") for k, t in (*FIELDS.items(), ("body", "content"))}
        parts = [x for k in ("caption", "summary", "description") if known.get(k) for x in split_text(tagged[k], size, overlap)]
        if image:
            optional = lambda k: [tagged[k]] if known[k] else []
            whole = "\n".join([*optional("caption"), tagged["summary"], tagged["description"], tagged["body"], *optional("footnote")])
            pieces = [whole] if len(whole) <= size else parts + [x for x in (split_text(tagged["body"], size, overlap) if known["body"] else [])]
        else:
            pieces = [m[0]] if len(m[0]) <= size else parts + table_parts(known["body"], size)
        for piece in pieces:
            add(piece, "image" if image else "table", m.start(), known)
    segment(text[end:], end)
    return out


def sub_chunk_column(size: int = SUB_CHUNK, overlap: int = 0):
    """:func:`sub_chunks` as a column function."""

    return text_column(lambda texts: texts.map(lambda t: None if t is None else [{n: s.get(n) for n in SUB.names} for s in sub_chunks(t, size, overlap)]), T.ArrayType(SUB))


def joined_subs(subs: Column, title: Column, start_page: Column) -> Column:
    """Sub-chunks of a parent (a list of :data:`SUB`), one that repeats its ``title`` joined to the next, with their pages and neighbours.

    Of repeating neighbours every other one joins its successor, which then repeats no more; the last one stays.
    """
    head, is_text = strip(title), lambda s: s["chunk_type"] == "text"
    repeats = lambda s: is_text(s) & F.coalesce(strip(F.regexp_replace(s["content"], r"#+\s*", "")) == head, F.lit(False))
    moved = F.aggregate(subs, F.array().cast("array<boolean>"), lambda done, s: F.concat(done, F.array(repeats(s) & ~F.coalesce(F.get(done, F.size(done) - 1), F.lit(False)))))
    none = F.array().cast("array<int>")

    def one(s: Column, i: Column, moves: Column) -> Column:
        joins = F.coalesce(F.get(moves, i - 1), F.lit(False))
        text = F.when(joins, F.concat(F.get(subs, i - 1)["content"], F.lit("\n\n"), s["content"])).otherwise(s["content"])
        beside = F.array_compact(F.array(*[F.when(is_text(s) != is_text(F.get(subs, i + k)), i + k) for k in (-1, 1)]))
        pages = F.array_sort(F.array_distinct(F.concat(F.array(F.coalesce(s["page"], start_page)), page_marks(s["content"]))))
        row = F.struct(
            (i - joins.cast("int")).alias("sub"), text.alias("sub_text"), s["chunk_type"].alias("chunk_type"), pages.alias("sub_page_numbers"), *[s[f].alias(f) for f in ELEMENT_FIELDS],
            i.alias("sub_id"), F.when(is_text(s), beside).otherwise(none).alias("related_assets"), F.when(is_text(s), none).otherwise(beside).alias("related_text"),
        )
        return F.when(~(F.get(moves, i) & (i < F.size(subs) - 1)), row)

    return bound(moved, lambda moves: F.filter(F.transform(subs, lambda s, i: one(s, i, moves)), lambda x: x.isNotNull()))


def chunk_documents(docs: DataFrame, items: DataFrame | None = None, *, size: int = SUB_CHUNK, most: int = PARENT_CHUNK, overlap: int = 0) -> DataFrame:
    """The whole chunker: doc_id, chunk, header, text, page_numbers, toc_path, all_subchapters, sub, sub_text, chunk_type, sub_page_numbers, an element's fields, sub_id, related_assets, related_text.

    ``docs``: doc_id, markdown.  One row a sub-chunk.  A sub-chunk that repeats the parent's heading joins the next; a
    parent without sub-chunks is its own.  Paths of image files leave the parent's text.  ``items`` (doc_id, pos, type,
    text_level, text) are the documents' content lists: their numbered headings give the paths; without them paths are
    empty.  related_assets of a text are the sub_ids of the figures and tables beside it in the parent, related_text of
    those the sub_ids of the texts, both as they were before headings joined.
    """
    whole = ["doc_id", "chunk", "header", "text", "page_numbers", "toc_path", "all_subchapters"]
    docs = docs.select("doc_id", "markdown")
    if items is not None:
        # contents are one row a document and meet it before it is cut
        docs = docs.join(contents_lists(contents_paths(contents_parents(numbered_headings(items)))), "doc_id", "left")
    else:
        docs = docs.withColumn("titles", F.lit(None).cast(TITLES))
    docs = _with_parents(docs, most, overlap)
    docs = docs.withColumn("__owners", latest_titles(F.transform("__parents", lambda p: p["text"]), F.col("titles"))).withColumn("__pages", starting_pages(F.col("__parents")))
    listed = F.arrays_zip(F.col("__parents").alias("p"), F.col("__owners").alias("owner"), F.col("__pages").alias("start_page"))
    rows = docs.select("doc_id", "titles", F.posexplode(listed).alias("chunk", "x")).select("doc_id", "titles", "chunk", "x.p.*", "x.owner", "x.start_page")
    pages = F.array_sort(F.array_distinct(F.concat(F.array("start_page"), page_marks(F.col("text")))))
    path, below = title_paths(F.col("titles"), F.col("owner"))
    rows = rows.select("doc_id", "chunk", "h1", "h2", "header", "text", "start_page", pages.alias("page_numbers"), path.alias("toc_path"), below.alias("all_subchapters"))
    cut = rows.withColumn("__subs", sub_chunk_column(size, overlap)(F.col("text")))
    subs = bound(F.col("__subs"), lambda subs: joined_subs(subs, F.coalesce("h2", "h1"), F.col("start_page")))
    out = cut.select(*whole, F.regexp_replace("text", IMAGE_PATH, "$1").alias("__shown"), F.explode_outer(subs).alias("s")).select(*whole, "__shown", "s.*")
    alone = F.col("sub_text").isNull()
    out = out.withColumn("sub_page_numbers", F.when(alone, F.col("page_numbers")).otherwise(F.col("sub_page_numbers")))
    out = out.withColumn("chunk_type", F.coalesce("chunk_type", F.lit("text"))).withColumn("sub_text", F.coalesce("sub_text", "text"))
    for name in ("sub", "sub_id"):
        out = out.withColumn(name, F.coalesce(name, F.lit(0)))
    for name in ("related_assets", "related_text"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<int>")))
    out = out.withColumn("text", F.col("__shown"))
    return out.select(*whole, "sub", "sub_text", "chunk_type", "sub_page_numbers", *ELEMENT_FIELDS, "sub_id", "related_assets", "related_text")


# Page marks


def _anchor(kind: str, text: str | None, table: str | None, image: str | None) -> str | None:
    """What marks an element's place: words with single spaces between them, or the end of a link to an image."""
    if kind in ("text", "title"):
        return " ".join((text or "").split()) or None
    if kind == "table" and table:
        return " ".join(table.strip()[:150].split()) or None
    if kind in ("table", "image", "equation") and image and image.strip():
        return f"](images/{image.strip().removeprefix('images/')})"
    return None


class _Places:
    """Where the anchors stand in a text whose blanks are single spaces, found once for all of them."""

    def __init__(self, markdown: str, anchors: set[str]):
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", markdown)]
        self.text, self.starts, self.flat = markdown, [a for a, _ in words], []
        at = 0
        for a, b in words:
            self.flat.append(at)
            at += b - a + 1
        joined = " ".join(markdown[a:b] for a, b in words)
        self.found = places(joined, {a for a in anchors if not a.startswith("](images/")})
        self.links = places(markdown, {a for a in anchors if a.startswith("](images/")})

    def _outer(self, flat: int) -> int:
        """The place in the text of one in the text with single spaces; never that of a blank."""
        word = bisect_right(self.flat, flat) - 1
        return self.starts[word] + flat - self.flat[word]

    def after(self, anchor: str, at: int) -> tuple[int, int] | None:
        """Begin and end of the anchor's first occurrence from ``at`` on."""
        if anchor in self.links:
            for place in self.links[anchor][bisect_left(self.links[anchor], at) :]:
                line = max(self.text.rfind("\n", 0, place) + 1, at)
                opened = self.text.find("![", line, place)
                if opened >= 0:
                    return opened, place + len(anchor)
            return None
        known = self.found.get(anchor, [])
        first = bisect_left(known, at, key=self._outer)
        return (self._outer(known[first]), self._outer(known[first] + len(anchor) - 1) + 1) if first < len(known) else None


def place_pages(markdown: str, items: list[tuple]) -> str:
    """``markdown`` with a mark before the first element found of each page; ``items``: (page index, kind, text, table, image) in order.

    The search never moves back; blanks may differ.  An element inside a heading has its mark before the line.  Page 1
    leads the text.  All elements are looked for in one pass over the text.
    """
    anchors = [(page, _anchor(*element)) for page, *element in items]
    known = _Places(markdown, {a for _, a in anchors if a})
    at, first = 0, {}
    for page, anchor in anchors:
        found = known.after(anchor, at) if anchor else None
        if found:
            first.setdefault(page, found[0])
            at = found[1]
    out, end = [], len(markdown)
    if not items:
        return markdown
    for page in sorted((p for p in first if p != 0), reverse=True):
        cut = first[page]
        start = markdown.rfind("\n", 0, cut) + 1
        if markdown[start:cut + 1].lstrip().startswith("#"):
            cut = start
        cut = min(cut, end)
        out.append(f'<seite nummer="{page + 1}" />\n\n{markdown[cut:end]}')
        end = cut
    return f'<seite nummer="1" />\n\n{markdown[:end]}' + "".join(reversed(out))


def insert_pages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` (doc_id, markdown) with page marks found by the elements' texts; documents that have marks, or no elements, stay.

    ``items``: doc_id, pos, page_idx, type, text, table_body, img_path.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "page_idx", "type", fix_mojibake(strip(F.col("text"))).alias("text"), "table_body", "img_path")))
    listed = items.groupBy("doc_id").agg(ordered.alias("__items"))

    def placed(texts: pd.Series, lists: pd.Series) -> pd.Series:
        keys = ("page_idx", "type", "text", "table_body", "img_path")
        return pd.Series([t if x is None or t is None else place_pages(t, [tuple(i[k] for k in keys) for i in x]) for t, x in zip(texts, lists, strict=True)])

    open_ = ~F.col("markdown").contains('<seite nummer="')
    out = docs.join(listed, "doc_id", "left")
    return out.withColumn("markdown", text_column(placed, T.StringType())("markdown", F.when(open_, F.col("__items")))).drop("__items")


def joined_parts(parts: DataFrame) -> DataFrame:
    """doc_id, markdown of documents that were read in parts; pages count on by each part's offset.

    ``parts``: doc_id, part, page_offset, markdown.  A document of one part passes through.  Only marks written exactly
    as the reader writes them are counted on.
    """
    several = F.count("*").over(Window.partitionBy("doc_id")) > 1
    pages = F.regexp_extract_all("markdown", F.lit(PART_PAGE), F.lit(1))
    gaps = F.split("markdown", PART_PAGE, -1)
    mark = lambda i: F.format_string('<seite nummer="%s" />', (F.get(pages, i).cast("long") + F.col("page_offset")).cast("string"))
    moved = F.array_join(F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(mark(i - 1), g))), "")
    rows = parts.withColumn("__several", several)
    rows = rows.withColumn("markdown", F.when(F.col("__several") & (F.col("page_offset") != 0), moved).otherwise(F.col("markdown")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "markdown"))), lambda x: x["markdown"]), "")
    return rows.groupBy("doc_id").agg(text.alias("markdown"))


def assembled_parts(parts: DataFrame, again: DataFrame) -> DataFrame:
    """doc_id, markdown, n_parts, error of documents read in parts, after the failed parts were read again.

    ``parts``: document_id, part, page_offset, action (see ``jobs.part_actions``), markdown; ``again``: document_id, part,
    markdown of what came of a second reading, null where that failed too.  Parts stand in the order of their pages; one
    that is lost leaves a gap, and a document without any is an error.
    """
    second = again.select("document_id", "part", F.col("markdown").alias("__again"))
    rows = parts.join(second, ["document_id", "part"], "left")
    text = F.when(F.col("action") == "keep", F.col("markdown")).when(F.col("action") == "rasterize", F.col("__again"))
    rows = rows.withColumn("markdown", text).withColumn("doc_id", F.col("document_id"))
    whole = joined_parts(rows.where("markdown is not null").select("doc_id", F.col("page_offset").alias("part"), "page_offset", "markdown"))
    counts = rows.groupBy("doc_id").agg(F.count("markdown").alias("n_parts"))
    return counts.join(whole, "doc_id", "left").withColumn("error", F.when(F.col("n_parts") == 0, "no part could be read"))


# Removals, injections and replacements


def without_elements(markdown: str, images: list[str], tables: list[str], known: list[str]) -> str:
    """``markdown`` without links and elements of ``images``, without ``tables``, and without links to images that are not ``known``."""
    bare = {i.removeprefix("images/") for i in images}
    if bare:
        names = "|".join(map(re.escape, sorted(bare)))
        kinds = [rf"!\[.*?\]\(images/(?:{names})\)", rf'<(?:BILD|TABELLE) img_path="images/(?:{names})"[^>]*/>\n*']
        kinds += [rf'<{t}[^>]*img_path="images/(?:{names})"[^>]*>.*?</{t}>\n*' for t in ("BILD", "TABELLE")]
        markdown = re.compile("|".join(kinds), re.DOTALL).sub("", markdown)
    for table in tables:
        markdown = markdown.replace(table, "")
    left = set(known) - bare
    return re.sub(r"!\[.*?\]\(images/([^)]+)\)", lambda m: m[0] if m[1] in left else "", markdown)


def apply_removals(docs: DataFrame, removals: DataFrame, images: DataFrame) -> DataFrame:
    """``docs`` (doc_id, markdown) after filtering.  ``removals``: doc_id, type, img_path, table_body; ``images``: doc_id, filename that exist."""
    gone = removals.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("type") == "image", F.col("img_path"))).alias("__images"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "table", F.nullif("table_body", F.lit(""))))).alias("__tables"),
    )
    known = images.groupBy("doc_id").agg(F.collect_set("filename").alias("__known"))

    def cleaned(texts: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        lists = lambda x: [] if x is None else list(x)
        return pd.Series([None if t is None else without_elements(t, lists(i), lists(h), lists(k)) for t, i, h, k in zip(texts, a, b, c, strict=True)])

    out = docs.join(gone, "doc_id", "left").join(known, "doc_id", "left")
    return out.withColumn("markdown", text_column(cleaned, T.StringType())("markdown", "__images", "__tables", "__known")).drop("__images", "__tables", "__known")


def inject_page_images(docs: DataFrame, images: DataFrame) -> DataFrame:
    """``docs`` with a link after the first mark of each image's page; page and link at the end where it has no mark.

    ``images``: doc_id, page_no, filename.
    """
    listed = images.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "filename"))).alias("__images"))

    def one(markdown: str, found) -> str:
        for page, name in ((i["page_no"], i["filename"]) for i in found):
            mark, link = f'<seite nummer="{page}" />', f"![Full page image](images/{name})"
            markdown = markdown.replace(mark, f"{mark}\n{link}", 1) if mark in markdown else f"{markdown}\n{mark}\n{link}"
        return markdown

    def injected(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([t if x is None or t is None else one(t, x) for t, x in zip(texts, lists, strict=True)])

    return docs.join(listed, "doc_id", "left").withColumn("markdown", text_column(injected, T.StringType())("markdown", "__images")).drop("__images")


def replace_once(markdown: str, blocks: dict[str, str], growth: int = 10, least_limit: int = 50 * 1024 * 1024) -> str:
    """Each key replaced where it first stands, longer keys first; stops before the text exceeds its limit."""
    blocks = {k: v for k, v in blocks.items() if k.strip()}
    if not blocks:
        return markdown
    limit, size = max(len(markdown) * growth, least_limit), len(markdown)
    out, end, done = [], 0, set()
    for start, key in leftmost_longest(markdown, blocks):
        if key in done:
            continue
        done.add(key)
        out += [markdown[end:start], blocks[key]]
        end = start + len(key)
        size += len(blocks[key]) - len(key)
        if size > limit:
            break
    return "".join([*out, markdown[end:]])


def apply_replacements(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``docs`` with each original element replaced once.  ``blocks``: doc_id, ord, original, block; the first block of an original counts."""
    first = blocks.where("original is not null").groupBy("doc_id", "original").agg(F.min_by("block", "ord").alias("block"))
    listed = first.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("original", "block"))).alias("__blocks"))

    def replaced(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([t if x is None or t is None else replace_once(t, dict(x)) for t, x in zip(texts, maps, strict=True)])

    return docs.join(listed, "doc_id", "left").withColumn("markdown", text_column(replaced, T.StringType())("markdown", "__blocks")).drop("__blocks")


def visual_inputs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, kind, image_ref of what a vision model is to see: tables with an image that the markdown still holds, then its other images.

    ``items``: doc_id, pos, type, img_path, table_body.  A table's body (or image) counts once.
    """
    key = F.coalesce(F.nullif("table_body", F.lit("")), "img_path")
    tables = items.where((F.col("type") == "table") & (F.coalesce("img_path", F.lit("")) != "")).withColumn("__key", key)
    once = Window.partitionBy("doc_id", "__key").orderBy("pos")
    tables = tables.withColumn("__rn", F.row_number().over(once)).where("__rn = 1").join(docs.select("doc_id", "markdown"), "doc_id")
    body = F.coalesce(F.nullif("table_body", F.lit("")), F.lit("\u0000"))
    tables = tables.where(F.col("markdown").contains(body) | F.col("markdown").contains(F.col("img_path"))).select("doc_id", F.lit("table").alias("kind"), F.col("img_path").alias("image_ref"))
    links = F.array_distinct(F.regexp_extract_all("markdown", F.lit(r"!\[.*?\]\((images/[^)]+)\)"), F.lit(1)))
    images = docs.select("doc_id", F.lit("image").alias("kind"), F.explode(links).alias("image_ref"))
    return tables.unionByName(images.join(tables.select("doc_id", "image_ref"), ["doc_id", "image_ref"], "left_anti"))
