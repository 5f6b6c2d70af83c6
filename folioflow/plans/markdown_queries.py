"""The chunker, heading trees, page marks, parts and layout documents over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.html import canonical_html
from ..operators import chunks as ch
from ..operators import enrich as en
from ..operators import layout_json as lj
from ..operators import markdown as md
from ..operators import tree as tr
from ..sources.tables import table
from . import fixtures as fx
from .registry import query


def _elements(spark, d):
    """``markdown`` with page marks; of its lines some are figures, some tables."""
    line = lambda x, i: F.when(
        i % 7 == 3, F.concat(F.lit('<BILD img_path="images/'), i.cast("string"), F.lit('.png">\n<summary>'), x, F.lit("</summary>\n</BILD>"))
    ).when(i % 7 == 5, F.concat(F.lit("<table><tr><td>"), x, F.lit("</td></tr></table>"))).otherwise(x)
    return fx.paged(spark, d).select("doc_id", F.array_join(F.transform(F.split("markdown", "\n"), line), "\n").alias("markdown"))


@query("c18_chunker")
def c18_chunker(spark, d):
    """With contents paths: the texts' first lines, numbered, are in the content list and in the markdown."""
    numbered = F.concat(F.lit("# 1.1 "), F.col("markdown"), F.lit("\n# 2 "), F.col("markdown"))
    docs = _elements(spark, d).withColumn("markdown", numbered)
    first = F.regexp_replace(F.get(F.split("text", "\n"), F.lit(0)), r"\s+$", "")
    listed = F.array(F.lit("1 Start"), F.concat(F.lit("1.1 # "), first), F.concat(F.lit("2 # "), first))
    items = table(spark, d, "documents").select("doc_id", F.posexplode(listed).alias("pos", "text")).select("doc_id", "pos", F.lit("text").alias("type"), F.lit(1).alias("text_level"), "text")
    return md.chunk_documents(docs, items)


@query("c13_isolated", """WITH m AS (SELECT doc_id, 'a ' || CASE WHEN doc_id % 2 = 0 THEN '<BILD x>' || chr(10) || 'z</BILD>' ELSE '' END || coalesce(text, '') || '<Table class="q">t</TABLE> b' AS markdown FROM documents)
  SELECT doc_id, 'a ' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '__SPECIAL_ELEMENT_PLACEHOLDER_0__' || chr(10) || chr(10) ELSE '' END || coalesce(text, '') || chr(10) || chr(10)
    || '__SPECIAL_ELEMENT_PLACEHOLDER_' || CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END || '__' || chr(10) || chr(10) || ' b' AS markdown FROM documents JOIN m USING (doc_id)""")
def c13_isolated(spark, d):
    figure = F.when(F.col("doc_id") % 2 == 0, "<BILD x>\nz</BILD>").otherwise("")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("a "), figure, F.coalesce("text", F.lit("")), F.lit('<Table class="q">t</TABLE> b')).alias("markdown"))
    return md.isolated(docs)[0]


@query("c14_header_sections", rf"""WITH {fx.MARKDOWN}, l AS (SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line FROM md),
  h AS (SELECT *, regexp_extract(line, '^\s*(##?) (.*)$', 1) AS mark, regexp_replace(regexp_extract(line, '^\s*(##?) (.*)$', 2), '^\s+|\s+$', '', 'g') AS title FROM l),
  s AS (SELECT *, sum((mark <> '')::INT) OVER w AS section, last_value(CASE WHEN mark = '#' THEN title END IGNORE NULLS) OVER w AS h1,
    last_value(CASE mark WHEN '#' THEN '-' WHEN '##' THEN '+' || title END IGNORE NULLS) OVER w AS h2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT doc_id, section, max(h1) AS h1, max(CASE WHEN h2 LIKE '+%' THEN substr(h2, 2) END) AS h2, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS text FROM s GROUP BY doc_id, section)
  SELECT doc_id, section::BIGINT AS section, h1, h2, text FROM g WHERE text <> ''""")
def c14_header_sections(spark, d):
    return md.header_sections(fx.markdown(spark, d))


@query("x11_joined_parts", """WITH p AS (SELECT conv_id AS doc_id, turn, text, CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN turn * 10 ELSE 0 END AS o FROM conversations)
  SELECT doc_id, string_agg('<seite nummer="' || (1 + o) || '" />' || coalesce(text, '') || '<seite nummer="2"/>', '' ORDER BY turn) AS markdown FROM p GROUP BY doc_id""")
def x11_joined_parts(spark, d):
    text = F.concat(F.lit('<seite nummer="1" />'), F.coalesce("text", F.lit("")), F.lit('<seite nummer="2"/>'))
    parts = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part"), (F.col("turn") * 10).alias("page_offset"), text.alias("markdown"))
    return md.joined_parts(parts)


_NODES = rf"""{fx.PAGED}, pl AS (SELECT doc_id, unnest(range(1, len(string_split(markdown, chr(10))) + 1)) AS line, unnest(string_split(markdown, chr(10))) AS row FROM paged),
  nodes AS (SELECT doc_id, line, length(regexp_extract(row, '^(#{{1,6}})\s+\S', 1)) AS level FROM pl WHERE regexp_matches(row, '^#{{1,6}}\s+\S'))"""


def _nodes(docs):
    return ch.header_nodes(docs).select("doc_id", "line", "level")


@query("w5_node_pages", rf"""WITH {_NODES}, le AS (SELECT doc_id, line, sum(length(row) + 1) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS at, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS more FROM pl),
  mk AS (SELECT doc_id, unnest(regexp_extract_all(markdown, '<seite\s+nummer="(\d+)"\s*/?>', 1)) AS page, unnest(range(1, len(regexp_extract_all(markdown, '<seite\s+nummer="(\d+)"\s*/?>')) + 1)) AS i, markdown FROM paged),
  ms AS (SELECT doc_id, page, i, length(markdown) AS n, list_sum(list_transform(regexp_split_to_array(markdown, '<seite\s+nummer="(\d+)"\s*/?>')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(markdown, '<seite\s+nummer="(\d+)"\s*/?>')[1:i - 1], lambda x: length(x))), 0) AS a FROM mk),
  pg AS (SELECT doc_id, page, i, a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY i), n) AS b, max(a) OVER (PARTITION BY doc_id) + 1 AS z FROM ms),
  nx AS (SELECT doc_id, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS nl FROM nodes),
  rg AS (SELECT nx.doc_id, nx.line, x.at AS f, y.at AS t FROM nx LEFT JOIN le x ON x.doc_id = nx.doc_id AND x.line = nx.line AND x.more IS NOT NULL LEFT JOIN le y ON y.doc_id = nx.doc_id AND y.line = nx.nl AND y.more IS NOT NULL)
  SELECT rg.doc_id, rg.line::INT AS line, CASE WHEN bool_or(pg.i IS NOT NULL) THEN coalesce(string_agg(page, ',' ORDER BY i) FILTER (a <= coalesce(t, z) AND b >= f), '') END AS pages FROM rg LEFT JOIN pg ON pg.doc_id = rg.doc_id GROUP BY rg.doc_id, rg.line""")
def w5_node_pages(spark, d):
    docs = fx.paged(spark, d)
    return tr.node_pages(docs, _nodes(docs)).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query("c30_thinned", rf"""WITH {_NODES}, tx AS (SELECT n.doc_id, n.line, n.level, regexp_replace(string_agg(row, chr(10) ORDER BY pl.line), '^\s+|\s+$', '', 'g') AS text FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS nl FROM nodes) n
    JOIN pl ON pl.doc_id = n.doc_id AND pl.line >= n.line AND (nl IS NULL OR pl.line < nl) GROUP BY ALL),
  e AS (SELECT t.*, (SELECT min(o.line) FROM tx o WHERE o.doc_id = t.doc_id AND o.line > t.line AND o.level <= t.level) AS stop FROM tx t),
  c AS (SELECT e.*, (SELECT sum(length(o.text)) FROM tx o WHERE o.doc_id = e.doc_id AND o.line >= e.line AND (e.stop IS NULL OR o.line < e.stop)) AS total FROM e),
  s AS (SELECT c.*, NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.line < c.line AND o.total < 400 AND (o.stop IS NULL OR o.stop > c.line)) AS stays FROM c),
  o AS (SELECT s.*, last_value(CASE WHEN stays THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS owner FROM s)
  SELECT doc_id, owner::INT AS line, max(level) FILTER (stays)::INT AS level, string_agg(text, chr(10) || chr(10) ORDER BY line) AS text FROM o GROUP BY doc_id, owner""")
def c30_thinned(spark, d):
    """Characters stand for tokens."""
    docs = fx.paged(spark, d)
    nodes = tr.own_texts(docs, _nodes(docs))
    sized = en.subtree_tokens(nodes.withColumn("tokens", F.length("text")))
    return tr.thinned(sized, 400)


@query("c33_node_summaries", rf"""WITH {_NODES}, tx AS (SELECT n.doc_id, n.line, n.level, regexp_replace(string_agg(row, chr(10) ORDER BY pl.line), '^\s+|\s+$', '', 'g') AS text FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS nl FROM nodes) n
    JOIN pl ON pl.doc_id = n.doc_id AND pl.line >= n.line AND (nl IS NULL OR pl.line < nl) GROUP BY ALL),
  s AS (SELECT doc_id, line, level, lead(level) OVER (PARTITION BY doc_id ORDER BY line) > level AS parent, CASE WHEN length(text) < 200 THEN text ELSE 'model: ' || text END AS said FROM tx)
  SELECT doc_id, line::INT AS line, CASE WHEN parent IS NOT TRUE THEN said END AS summary, CASE WHEN parent THEN said END AS prefix_summary FROM s""")
def c33_node_summaries(spark, d):
    """A mark before the text stands for a model."""
    docs = fx.paged(spark, d)
    nodes = ch.heading_parents(tr.own_texts(docs, _nodes(docs))).withColumn("tokens", F.length("text"))
    return tr.node_summaries(nodes, lambda t: F.concat(F.lit("model: "), t)).select("doc_id", "line", "summary", "prefix_summary")


_TOC = """toc AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 7) || '.' WHEN 1 THEN (o_orderkey % 5) || '.' || (o_orderkey % 3) WHEN 2 THEN '1.2.' || (o_orderkey % 3) ELSE 'no' END || ' ' || o_orderpriority AS text FROM orders)"""


def _toc(spark, d):
    from pyspark.sql.window import Window

    k = F.col("o_orderkey")
    digits = lambda n: (k % n).cast("string")
    number = F.when(k % 4 == 0, F.concat(digits(7), F.lit("."))).when(k % 4 == 1, F.concat(digits(5), F.lit("."), digits(3))).when(k % 4 == 2, F.concat(F.lit("1.2."), digits(3))).otherwise("no")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(k)).alias("pos"), F.lit("text").alias("type"), F.lit(1).alias("text_level"), F.concat_ws(" ", number, "o_orderpriority").alias("text")
    )


@query("w13_contents_parents", rf"""WITH {_TOC}, h AS (SELECT doc_id, pos, text AS title, len(string_split(regexp_replace(regexp_extract(text, '^([\d.]+)\s+(.*)', 1), '^\.+|\.+$', '', 'g'), '.')) AS level FROM toc WHERE regexp_matches(text, '^([\d.]+)\s+(.*)')),
  p AS (SELECT h.*, coalesce((SELECT arg_max(o.title, o.pos) FROM h o WHERE o.doc_id = h.doc_id AND o.pos < h.pos AND o.level < h.level), '_DOCUMENT_ROOT_') AS parent FROM h)
  SELECT doc_id, title, min(pos)::INT AS ord, arg_max(parent, pos) AS parent FROM p GROUP BY doc_id, title""")
def w13_contents_parents(spark, d):
    return tr.contents_parents(tr.numbered_headings(_toc(spark, d)))


@query("w13_contents_paths", rf"""WITH RECURSIVE {_TOC}, h AS (SELECT doc_id, pos, text AS title, len(string_split(regexp_replace(regexp_extract(text, '^([\d.]+)\s+(.*)', 1), '^\.+|\.+$', '', 'g'), '.')) AS level FROM toc WHERE regexp_matches(text, '^([\d.]+)\s+(.*)')),
  p AS (SELECT h.*, coalesce((SELECT arg_max(o.title, o.pos) FROM h o WHERE o.doc_id = h.doc_id AND o.pos < h.pos AND o.level < h.level), '_DOCUMENT_ROOT_') AS parent FROM h),
  q AS (SELECT doc_id, title, arg_max(parent, pos) AS parent FROM p GROUP BY doc_id, title),
  w AS (SELECT doc_id, title, title AS path, 1 AS depth FROM q WHERE parent = '_DOCUMENT_ROOT_' UNION ALL SELECT q.doc_id, q.title, w.path || ' > ' || q.title, depth + 1 FROM q JOIN w ON w.doc_id = q.doc_id AND q.parent = w.title)
  SELECT doc_id, title, path, depth FROM w""")
def w13_contents_paths(spark, d):
    paths = tr.contents_paths(tr.contents_parents(tr.numbered_headings(_toc(spark, d))))
    return paths.select("doc_id", "title", F.array_join("path", " > ").alias("path"), F.size("path").alias("depth"))


_TREE = f"""{_NODES}, th AS (SELECT doc_id, line, length(regexp_extract(row, '^(#{{1,6}})\\s', 1)) AS level, regexp_replace(row, '^#{{1,6}}\\s+|\\s+$', '', 'g') AS title FROM pl WHERE (doc_id, line) IN (SELECT doc_id, line FROM nodes)),
  tp AS (SELECT doc_id, line, title, 1 + (level > 1 AND EXISTS (SELECT 1 FROM th o WHERE o.doc_id = h.doc_id AND o.line < h.line AND o.level < h.level))::INT AS depth FROM th h)"""


def _tree(spark, d):
    """Headings with titles in reading order, as nested JSON."""
    nodes = ch.heading_parents(ch.header_nodes(fx.paged(spark, d)))
    return tr.nested_tree(nodes, ["line", "title"])


@query("c31_nested_trees", f"""WITH {_TREE}, nx AS (SELECT *, lead(depth) OVER (PARTITION BY doc_id ORDER BY line) AS after, to_json({{'line': line::INT, 'title': title}})::VARCHAR AS o FROM tp)
  SELECT doc_id, '[' || string_agg(CASE WHEN after > depth THEN left(o, length(o) - 1) || ',"nodes":[' ELSE o || repeat(']}}', (depth - coalesce(after, 1))::INT) || CASE WHEN after IS NULL THEN '' ELSE ',' END END, '' ORDER BY line) || ']' AS tree FROM nx GROUP BY doc_id""")
def c31_nested_trees(spark, d):
    return _tree(spark, d)


@query("c31_flat_trees", f"WITH {_TREE} SELECT doc_id, line::INT AS line, title, depth::INT AS depth FROM tp")
def c31_flat_trees(spark, d):
    """From the nested JSON back to rows."""
    return tr.flat_tree(_tree(spark, d), "line int, title string").select("doc_id", "line", "title", F.size("place").alias("depth"))


@query("a22_document_summaries", f"""WITH {fx.LINES}, p AS (SELECT doc_id, (pos - 1) // 25 AS b, string_agg('<seite nummer="' || pos || '" />' || line, chr(10) ORDER BY pos) AS text FROM lines WHERE pos > 0 GROUP BY ALL),
  s AS (SELECT doc_id, count(*) AS n, string_agg('S' || text, chr(10) ORDER BY b) AS text FROM p GROUP BY doc_id)
  SELECT d.doc_id AS document_id, CASE WHEN s.doc_id IS NULL THEN '' WHEN n > 1 AND length(s.text) > 3000 THEN 'C' || s.text ELSE s.text END AS summary FROM documents d LEFT JOIN s USING (doc_id)""")
def a22_document_summaries(spark, d):
    """Letters before the text stand for summaries (of parts of 25 pages) and for condensing."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit('<seite nummer="'), i.cast("string"), F.lit('" />'), x)))
    docs = table(spark, d, "documents").select("doc_id", F.array_join(marked, "").alias("markdown"))
    mark = lambda x: lambda t: F.concat(F.lit(x), t)
    return tr.document_summaries(docs, mark("S"), mark("C"), group=25, part_limit=1 << 30)


@query("c8_canonical_html")
def c8_canonical_html(spark, d):
    return table(spark, d, "pages").select("page_id", canonical_html(F.col("html")).alias("out"))


@query("c43_visual_blocks", r"""SELECT doc_id, chr(10) || chr(10) || '<' || CASE WHEN doc_id % 2 = 0 THEN 'TABELLE' ELSE 'BILD' END || ' img_path="i.png">' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '<caption_text>cap</caption_text>' ELSE '' END || chr(10)
  || '<content>' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '[Content removed due to potential hallucination]' ELSE 'x ' || doc_id END || chr(10) || '</content>' || chr(10) || '<description>' || chr(10) || 'said' || chr(10) || '</description>' || chr(10)
  || '<summary>' || chr(10) || 'short' || chr(10) || '</summary>' || chr(10) || '</' || CASE WHEN doc_id % 2 = 0 THEN 'TABELLE' ELSE 'BILD' END || '>' AS out FROM documents""")
def c43_visual_blocks(spark, d):
    k = F.col("doc_id")
    block = tx.visual_block(
        F.when(k % 2 == 0, "table").otherwise("image"), F.lit("i.png"), F.concat(F.lit(" x "), k.cast("string"), F.lit("\n")), F.lit("said"), F.lit(" short "),
        F.when(k % 3 == 0, "cap"), F.lit(""), k % 5 == 0, F.lit(False),
    )
    return table(spark, d, "documents").select("doc_id", block.alias("out"))


def _layout(spark, d):
    """A layout of every document: line by line, some lines headings, pictures, tables, furniture or children of the line before."""
    lines = fx.lines(spark, d)
    k = F.col("pos")
    kind = F.when(k % 6 == 2, "tables").when(k % 6 == 4, "pictures").otherwise("texts")
    ref = lambda kind, k: F.concat(F.lit("#/"), kind, F.lit("/"), k.cast("string"))
    label = F.when(k % 9 == 0, "title").when(k % 9 == 3, "section_header").when(k % 9 == 7, "Page_Footer").when(k % 9 == 5, "list_item").otherwise("text")
    child = F.when(k % 6 == 0, F.array(ref(F.lit("texts"), k + 1))).otherwise(F.array().cast("array<string>"))
    items = lines.select("doc_id", k.alias("item"), ref(kind, k).alias("ref"), kind.alias("kind"), F.lit("#/body").alias("parent"), label.alias("label"), F.lit("body").alias("content_layer"),
                         F.col("line").alias("text"), F.lit("*").alias("marker"), (F.floor(k / 4) + 1).cast("int").alias("page_no"), child.alias("children"),
                         F.array(F.lit(0.0), 800.0 - (k % 4) * 100, F.lit(50.0), 850.0 - (k % 4) * 100).alias("bbox"))
    body = items.where("item % 6 <> 1").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "ref"))), lambda x: x["ref"]).alias("body"))
    meta = lines.where("pos % 6 in (2, 4) and pos % 5 > 0").select("doc_id", ref(kind, k).alias("self_ref"), k.alias("ord"), F.concat(k.cast("string"), F.lit(".png")).alias("img_path"), F.concat(F.lit("<table>"), "line", F.lit("</table>")).alias("html"),
                                                                  F.concat(k.cast("string"), F.lit(".png")).alias("filename"), F.when(k % 8 == 4, "Bild 3").otherwise(F.lit("view")).alias("caption"))
    return body, lj.with_metadata(items, meta)


@query("c37_layout_markdown", """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
  i AS (SELECT *, CASE pos % 6 WHEN 2 THEN 'tables' WHEN 4 THEN 'pictures' ELSE 'texts' END AS kind, pos // 4 + 1 AS page, pos % 5 > 0 AS meta FROM l WHERE pos % 9 <> 7 AND NOT (pos % 6 = 1 AND (pos - 1) % 9 = 7)),
  o AS (SELECT *, kind <> 'texts' OR line <> '' AS speaks, count(*) FILTER (kind = 'pictures') OVER w AS number FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  m AS (SELECT *, coalesce(max(CASE WHEN speaks THEN page END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM o),
  p AS (SELECT doc_id, pos, CASE WHEN speaks AND page > top THEN chr(10) || '<seite nummer="' || page || '" />' || chr(10) END AS mark,
    CASE WHEN kind = 'texts' AND NOT speaks THEN NULL WHEN kind = 'texts' THEN CASE WHEN pos % 9 = 0 THEN chr(10) || '# ' || line || chr(10) WHEN pos % 9 = 3 THEN chr(10) || '## ' || line || chr(10) WHEN pos % 9 = 5 THEN '* ' || line ELSE chr(10) || line || chr(10) END
      WHEN NOT meta THEN NULL WHEN kind = 'tables' THEN chr(10) || '<TABELLE img_path="images/' || pos || '.png">' || chr(10) || '<table>' || line || '</table>' || chr(10) || '</TABELLE>' || chr(10)
      ELSE chr(10) || '![' || CASE WHEN pos % 8 = 4 THEN 'Image ' || number ELSE 'view' END || '](images/' || pos || '.png)' || chr(10) END AS body FROM m)
  SELECT doc_id, coalesce(string_agg(concat_ws(chr(10), mark, body), chr(10) ORDER BY pos) FILTER (mark IS NOT NULL OR body IS NOT NULL), '') AS markdown FROM p GROUP BY doc_id""")
def c37_layout_markdown(spark, d):
    body, items = _layout(spark, d)
    none = items.select("doc_id", "ref", F.lit("").alias("caption")).limit(0)
    return lj.to_markdown(lj.walk(body, items), none)


@query("s19_resolved_references", """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)
  SELECT a.doc_id, a.pos::INT AS item, b.line AS text FROM l a LEFT JOIN l b ON b.doc_id = a.doc_id AND b.pos = a.pos + 7 AND b.pos % 6 NOT IN (2, 4)""")
def s19_resolved_references(spark, d):
    """Each element refers to the text seven lines below, which may be none, or none that is a text."""
    items = _layout(spark, d)[1]
    wanted = items.select("doc_id", "item", F.concat(F.lit("#/texts/"), (F.col("item") + 7).cast("string")).alias("ref"))
    return lj.resolved(wanted, items.select("doc_id", "ref", "text")).select("doc_id", "item", "text")


@query("c38_content_list", """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
  i AS (SELECT *, CASE pos % 6 WHEN 2 THEN 'table' WHEN 4 THEN 'image' ELSE 'text' END AS type, pos % 5 > 0 AS meta FROM l)
  SELECT doc_id, type, CASE WHEN type = 'text' THEN line END AS text, CASE WHEN type = 'text' AND pos % 9 IN (0, 3) THEN 1 END AS text_level, (pos // 4)::INT AS page, CASE WHEN type = 'table' THEN CASE WHEN meta THEN '<table>' || line || '</table>' ELSE '' END END AS table_body,
    CASE WHEN type <> 'text' AND meta THEN 'images/' || pos || '.png' END AS img_path, 842.0::DOUBLE - (850 - (pos % 4) * 100) AS top FROM i WHERE type <> 'text' OR (pos % 9 <> 7 AND line <> '')""")
def c38_content_list(spark, d):
    items = _layout(spark, d)[1]
    heights = items.select("doc_id", "page_no", F.lit(842.0).alias("height")).distinct()
    out = lj.content_list(items, heights)
    return out.select("doc_id", "type", "text", "text_level", "page", "table_body", "img_path", F.get("bbox", F.lit(1)).alias("top"))


@query("c12_insert_pages")
def c12_insert_pages(spark, d):
    """The lines of a text are its elements, seven a page."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("markdown"))
    empty = F.lit(None).cast("string")
    items = fx.lines(spark, d).select("doc_id", "pos", F.floor(F.col("pos") / 7).cast("int").alias("page_idx"), F.lit("text").alias("type"), F.col("line").alias("text"), empty.alias("table_body"), empty.alias("img_path"))
    return md.insert_pages(docs, items)


@query("f5_apply_removals", """SELECT doc_id, coalesce(text, '') || ' x  y' || CASE WHEN doc_id % 2 = 0 THEN '![b](images/b.png)' ELSE '' END || '' AS markdown FROM documents""")
def f5_apply_removals(spark, d):
    """A link and a table are filtered, a figure with them; of two other links one has no file in odd documents."""
    k = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(' x ![a](images/a.png)<table>t</table> y<BILD img_path="images/a.png">z</BILD>![b](images/b.png)![c](images/c.png)'))
    docs = table(spark, d, "documents").select("doc_id", text.alias("markdown"))
    none = F.lit(None).cast("string")
    gone = docs.select("doc_id", F.lit("image").alias("type"), F.lit("images/a.png").alias("img_path"), none.alias("table_body"))
    gone = gone.unionByName(docs.select("doc_id", F.lit("table").alias("type"), none.alias("img_path"), F.lit("<table>t</table>").alias("table_body")))
    images = docs.select("doc_id", F.explode(F.when(k % 2 == 0, F.array(F.lit("a.png"), F.lit("b.png"))).otherwise(F.array(F.lit("a.png")))).alias("filename"))
    return md.apply_removals(docs, gone, images)


@query("f26_inject_images", """SELECT doc_id, '<seite nummer="1" />' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '![Full page image](images/p1.png)' ELSE '' END || coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '<seite nummer="9" />' || chr(10) || '![Full page image](images/p9.png)' ELSE '' END AS markdown FROM documents""")
def f26_inject_images(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit('<seite nummer="1" />'), F.coalesce("text", F.lit(""))).alias("markdown"))
    pages = docs.select("doc_id", F.explode(F.array_compact(F.array(F.when(k % 2 == 0, 1), F.when(k % 3 == 0, 9)))).alias("page_no"))
    return md.inject_page_images(docs, pages.withColumn("filename", F.format_string("p%d.png", "page_no")))


@query("c42_apply_replacements", """SELECT doc_id, 'one TWO and ' || CASE WHEN doc_id % 2 = 0 THEN '[two]' ELSE 'TWO' END || ' ' || coalesce(text, '') AS markdown FROM documents""")
def c42_apply_replacements(spark, d):
    """A key and a longer one that holds it; each is replaced where it first stands, before the text."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("ONE TWO and TWO "), F.coalesce("text", F.lit(""))).alias("markdown"))
    block = lambda n, a, b, when: docs.where(when).select("doc_id", F.lit(n).alias("ord"), F.lit(a).alias("original"), F.lit(b).alias("block"))
    blocks = block(0, "ONE TWO", "one TWO", F.lit(True)).unionByName(block(1, "TWO", "[two]", k % 2 == 0)).unionByName(block(2, "ONE TWO", "late", F.lit(True)))
    return md.apply_replacements(docs, blocks)


@query("c44_visual_inputs", """SELECT doc_id, 'table' AS kind, 'images/t.png' AS image_ref FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'image', 'images/t.png' FROM documents WHERE doc_id % 2 > 0 UNION ALL SELECT doc_id, 'image', 'images/i.png' FROM documents""")
def c44_visual_inputs(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("![x](images/t.png) ![](images/i.png) ![y](images/i.png)")).alias("markdown"))
    one = lambda pos, image: docs.select("doc_id", F.lit(pos).alias("pos"), F.lit("table").alias("type"), F.lit(image).alias("img_path"), F.lit("").alias("table_body"))
    items = one(0, "images/t.png").unionByName(one(1, "images/t.png")).where(k % 2 == 0).unionByName(one(2, "images/gone.png"))
    return md.visual_inputs(docs, items)


@query("s26_embedded_images", "SELECT page_id, sha256(html) AS sha FROM pages WHERE html IS NOT NULL")
def s26_embedded_images(spark, d):
    uri = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("html", "UTF-8")))
    return table(spark, d, "pages").where("html is not null").select("page_id", F.sha2(lj.embedded_image(uri), 256).alias("sha"))


@query("s28_crop_boxes", "SELECT p_partkey, greatest(0, p_size * 2 - 5) AS left, greatest(0, trunc(p_size * 3)::INT - 5) AS top, least(400, p_size * 2 + 100 + 5) AS right, least(900, p_size * 3 + 150 + 5) AS bottom FROM part")
def s28_crop_boxes(spark, d):
    size = F.col("p_size").cast("double")
    rows = table(spark, d, "part").select("p_partkey", F.array(size, size, size + 50, size + 50).alias("bbox"), F.lit(200.0).alias("page_width"), F.lit(300.0).alias("page_height"), F.lit(400).alias("image_width"), F.lit(900).alias("image_height"))
    return lj.crop_boxes(rows).select("p_partkey", "left", "top", "right", "bottom")
