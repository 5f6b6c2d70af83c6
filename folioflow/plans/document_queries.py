"""Chunks, headings, layout elements over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import chunks as ch
from ..operators import graph as gr
from ..operators import layout as la
from ..sources.tables import table
from . import fixtures as fx
from .registry import query


def _flat(df, *arrays):
    """Arrays as joined text, so that both engines hash alike."""
    for a in arrays:
        df = df.withColumn(a, F.array_join(F.col(a).cast("array<string>"), ","))
    return df


@query("w1_links", f"""WITH {fx.CHUNKS} SELECT chunk_id, lag(chunk_id) OVER w AS previous_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM chunks
  WINDOW w AS (PARTITION BY document_id ORDER BY seq)""")
def w1_links(spark, d):
    return ch.links(fx.chunks(spark, d)).select("chunk_id", "previous_chunk_id", "next_chunk_id")


@query("w7_related_assets", f"""WITH {fx.CHUNKS}, n AS (SELECT chunk_id, chunk_type, unnest([lag(chunk_id) OVER w, lead(chunk_id) OVER w]) AS related_id,
  unnest([lag(chunk_type) OVER w, lead(chunk_type) OVER w]) AS other FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY seq))
  SELECT chunk_id, related_id FROM n WHERE related_id IS NOT NULL AND (chunk_type = 'text') <> (other = 'text')""")
def w7_related_assets(spark, d):
    return ch.related_assets(fx.chunks(spark, d))


@query("t4_batches", f"WITH {fx.CHUNKS} SELECT chunk_id, ((row_number() OVER (PARTITION BY document_id ORDER BY seq) - 1) // 3)::INT AS batch FROM chunks")
def t4_batches(spark, d):
    return ch.batches(fx.chunks(spark, d), "document_id", "seq", 3).select("chunk_id", "batch")


@query("w10_connected_run", f"""WITH {fx.CHUNKS}, r AS (SELECT chunk_id, min((toc_path <> 'assistant')::INT) OVER (PARTITION BY document_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM chunks)
  SELECT chunk_id FROM r WHERE run = 1""")
def w10_connected_run(spark, d):
    return ch.connected_run(fx.chunks(spark, d).withColumn("flag", F.col("toc_path") != "assistant"), "flag").select("chunk_id")


@query("w11_first_positive", f"WITH {fx.CHUNKS} SELECT document_id, min(seq) AS seq FROM chunks WHERE toc_path = 'assistant' GROUP BY document_id")
def w11_first_positive(spark, d):
    return ch.first_positive(fx.chunks(spark, d).withColumn("flag", F.col("toc_path") == "assistant"), "flag")


@query("w2_fill_forward", f"""WITH {fx.CHUNKS} SELECT chunk_id, last_value(CASE WHEN seq % 3 = 0 THEN chunk_id END IGNORE NULLS)
  OVER (PARTITION BY document_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS resolved FROM chunks""")
def w2_fill_forward(spark, d):
    return ch.fill_forward(fx.chunks(spark, d).withColumn("path", F.when(F.col("seq") % 3 == 0, F.col("chunk_id"))), "path").select("chunk_id", "resolved")


@query("w3_pages_of_chunks", f"""WITH {fx.CHUNKS}, m AS (SELECT document_id, seq, chunk_id, CASE seq % 3 WHEN 0 THEN [] WHEN 1 THEN [seq + 1] ELSE [seq + 2, seq + 3] END AS marks, seq % 3 = 1 AS leads FROM chunks),
  t AS (SELECT *, max(list_max(marks)) OVER (PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM m)
  SELECT chunk_id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN leads THEN [] ELSE [coalesce(top, 1)] END, marks))), ',') AS page_numbers FROM t""")
def w3_pages_of_chunks(spark, d):
    mark = lambda n: F.concat(F.lit('<seite nummer="'), (F.col("seq") + n).cast("string"), F.lit('" />'))
    text = F.when(F.col("seq") % 3 == 0, F.col("text")).when(F.col("seq") % 3 == 1, F.concat(mark(1), F.col("text"))).otherwise(F.concat(F.lit("x"), mark(2), F.col("text"), mark(3)))
    return _flat(ch.page_of_chunks(fx.chunks(spark, d).withColumn("text", text)).select("chunk_id", "page_numbers"), "page_numbers")


@query("c53_merge_small", f"""WITH RECURSIVE {fx.LINES}, f AS (
    SELECT doc_id, pos, length(line) AS size, (length(line) >= 800)::INT AS cut, 0 AS part FROM lines WHERE pos = 0
    UNION ALL SELECT l.doc_id, l.pos, CASE WHEN f.cut = 1 THEN 0 ELSE f.size END + length(l.line), (CASE WHEN f.cut = 1 THEN 0 ELSE f.size END + length(l.line) >= 800)::INT, f.part + f.cut
    FROM f JOIN lines l ON l.doc_id = f.doc_id AND l.pos = f.pos + 1),
  e AS (SELECT doc_id, pos, part, max(cut) OVER (PARTITION BY doc_id, part) AS is_full FROM f),
  p AS (SELECT doc_id, pos, CASE WHEN is_full = 1 THEN part ELSE greatest(part - 1, 0) END AS part FROM e)
  SELECT doc_id AS document_id, part::INT AS part, string_agg(line, chr(10) ORDER BY pos) AS text, count(*)::INT AS n_chunks FROM p JOIN lines USING (doc_id, pos) GROUP BY ALL""")
def c53_merge_small(spark, d):
    return ch.merge_small(fx.lines(spark, d).select(F.col("doc_id").alias("document_id"), F.col("pos").alias("seq"), F.col("line").alias("text")))


_HEADS = f"""{fx.MARKDOWN}, hl AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS text FROM md),
  heads AS (SELECT doc_id, line, length(regexp_extract(text, '^(#{{1,6}})\\s+\\S', 1)) AS level, regexp_replace(text, '^#{{1,6}}\\s+|\\s+$', '', 'g') AS title FROM hl WHERE regexp_matches(text, '^#{{1,6}}\\s+\\S'))"""


@query("c29_header_nodes", f"WITH {_HEADS} SELECT doc_id, line::INT AS line, level::INT AS level, title FROM heads")
def c29_header_nodes(spark, d):
    return ch.header_nodes(fx.markdown(spark, d))


@query("w12_heading_parents", f"""WITH {_HEADS} SELECT doc_id, line::INT AS line, (SELECT max(o.line) FROM heads o WHERE o.doc_id = h.doc_id AND o.line < h.line AND o.level < h.level
    )::INT AS parent FROM heads h""")
def w12_heading_parents(spark, d):
    return ch.heading_parents(ch.header_nodes(fx.markdown(spark, d))).select("doc_id", "line", "parent")


@query("w15_node_ids", f"WITH {_HEADS} SELECT doc_id, line::INT AS line, lpad((row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1)::VARCHAR, 4, '0') AS node_id FROM heads")
def w15_node_ids(spark, d):
    return gr.pre_order(ch.header_nodes(fx.markdown(spark, d)).withColumn("ord", F.col("line"))).select("doc_id", "line", "node_id")


@query("w6_section_ranges", f"""WITH {_HEADS} SELECT h.doc_id, h.line::INT AS line, coalesce(lead(h.line) OVER (PARTITION BY h.doc_id ORDER BY h.line) - 1, len(md.lines))::INT AS last_line
  FROM heads h JOIN md USING (doc_id)""")
def w6_section_ranges(spark, d):
    docs = fx.markdown(spark, d)
    n = docs.select("doc_id", F.size(F.split("markdown", "\n")).alias("n"))
    return ch.node_text_ranges(ch.header_nodes(docs).join(n, "doc_id"), F.col("n")).select("doc_id", "line", "last_line")


@query("w14_sections", rf"""WITH {fx.MARKDOWN}, l AS (SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line FROM md),
  h AS (SELECT *, regexp_extract(line, '^(##?)\s+(.*)$', 1) AS mark, trim(regexp_extract(line, '^(##?)\s+(.*)$', 2)) AS title FROM l),
  s AS (SELECT *, sum((mark <> '')::INT) OVER w AS section, last_value(CASE WHEN mark = '#' THEN title END IGNORE NULLS) OVER w AS h1,
    nullif(last_value(CASE mark WHEN '#' THEN '' WHEN '##' THEN title END IGNORE NULLS) OVER w, '') AS h2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
  SELECT doc_id, section::BIGINT AS section, max(h1) AS h1, max(h2) AS h2, string_agg(line, chr(10) ORDER BY pos) AS text FROM s GROUP BY doc_id, section""")
def w14_sections(spark, d):
    return ch.sections(fx.markdown(spark, d))


@query("c10_page_parts", f"""WITH RECURSIVE {fx.LINES}, p AS (SELECT doc_id, (pos - 1) // 5 AS part, string_agg('<seite  nummer = "' || pos || '" />' || line || chr(10), '' ORDER BY pos) AS text FROM lines WHERE pos > 0 GROUP BY ALL),
  {fx.cut_sql("SELECT doc_id, part, text FROM p", "doc_id, part", 3000)}
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, n) - 1)::INT AS part, piece AS text FROM cut WHERE piece IS NOT NULL""")
def c10_page_parts(spark, d):
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit('<seite  nummer = "'), i.cast("string"), F.lit('" />'), x, F.lit("\n"))))
    docs = table(spark, d, "documents").select("doc_id", F.array_join(marked, "").alias("markdown"))
    return docs.select("doc_id", F.posexplode(ch.page_parts(F.col("markdown"), most=3000)).alias("part", "text"))


@query("j23_nearby_lines", f"""WITH {fx.LINES}, a AS (SELECT doc_id, min(pos) AS k FROM lines WHERE contains(line, 'license') GROUP BY doc_id)
  SELECT doc_id, string_agg(trim(line), chr(10) ORDER BY pos) AS context FROM lines JOIN a USING (doc_id) WHERE abs(pos - k) <= 2 AND pos <> k AND trim(line) <> '' GROUP BY doc_id""")
def j23_nearby_lines(spark, d):
    lines = fx.lines(spark, d)
    anchor = lines.where(F.col("line").contains("license")).groupBy("doc_id").agg(F.min("pos").alias("pos"))
    return ch.around(lines, anchor, 2)


@query("f1_furniture", f"WITH {fx.LINES}, {fx.ITEMS} SELECT doc_id, item FROM items WHERE lower(label) IN ('page_header', 'page_footer', 'page-header', 'page-footer') OR lower(coalesce(layer, '')) = 'furniture'")
def f1_furniture(spark, d):
    return fx.items(spark, d).where(la.is_furniture(F.col("label"), F.col("layer"))).select("doc_id", "item")


_RECURRING = rf"""{fx.LINES}, {fx.ITEMS}, z AS (SELECT *, bbox[4] < 842 * 0.12 OR bbox[2] > 842 * (1 - 0.18) AS margin, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body,
    regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '^\s+|\s+$', '', 'g') AS plain FROM items),
  s AS (SELECT doc_id, item, page, bbox[2] AS y0, 'table' AS kind, body AS sig FROM z WHERE type = 'table' AND margin
    UNION ALL SELECT doc_id, item, page, bbox[2], 'text', body FROM z WHERE type = 'text' AND margin
    UNION ALL SELECT doc_id, item, page, bbox[2], 'digits', plain FROM z WHERE type = 'text' AND margin AND plain <> body
    UNION ALL SELECT doc_id, item, page, bbox[2], 'image', phash::VARCHAR FROM z WHERE type = 'image'),
  r AS (SELECT doc_id, item, row_number() OVER (PARTITION BY doc_id, kind, sig ORDER BY page, y0, item) AS rn FROM s WHERE sig <> '')"""


@query("f3_recurring_elements", f"WITH {_RECURRING} SELECT DISTINCT doc_id, item FROM r WHERE rn > 1")
def f3_recurring_elements(spark, d):
    return la.recurring(fx.items(spark, d))


@query("f3_recurring_zone_twice", f"WITH {_RECURRING} SELECT doc_id, item FROM r WHERE rn > 1 UNION SELECT doc_id, item FROM z WHERE type = 'image' AND margin")
def f3_recurring_zone_twice(spark, d):
    return la.recurring(fx.items(spark, d), double_count_zone_images=True)


@query("t1_reading_order", f"""WITH {fx.LINES}, {fx.ITEMS} SELECT doc_id, item, (row_number() OVER (PARTITION BY doc_id ORDER BY page, bbox[2], CASE type WHEN 'text' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, item) - 1)::INT AS pos FROM items""")
def t1_reading_order(spark, d):
    return la.reading_order(fx.items(spark, d)).select("doc_id", "item", "pos")


@query("f19_full_page_images", f"""WITH {fx.LINES}, {fx.ITEMS}, p AS (SELECT doc_id, page, sum(CASE WHEN type = 'text' THEN (bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) ELSE 0 END) AS area,
    count(*) FILTER (item % 2 = 0 AND type <> 'text') AS busy FROM items GROUP BY ALL) SELECT doc_id, page FROM p WHERE busy = 0 AND area / (300.0 * 100.0) < 0.1""")
def f19_full_page_images(spark, d):
    items = fx.items(spark, d)
    pages = items.select("doc_id", "page").distinct().withColumns({"has_image": F.lit(True), "width": F.lit(300.0), "height": F.lit(100.0)})
    return la.full_page_images(pages, items.where((F.col("item") % 2 == 0) | (F.col("type") == "text")))


@query("a2_near_images", """WITH h AS (SELECT vec_id, label, list_reduce(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1::UBIGINT ELSE 0::UBIGINT END), lambda a, b: (a << 1) | b) AS h FROM embeddings),
  i AS (SELECT label, vec_id * 2 AS item, h FROM h UNION ALL SELECT label, vec_id * 2 + 1, xor(h, ((1::UBIGINT << (vec_id % 13)::INT) - 1)::UBIGINT) FROM h)
  SELECT a.label AS doc_id, a.item, b.item AS other FROM i a JOIN i b ON a.label = b.label AND a.item < b.item WHERE bit_count(xor(a.h, b.h)) <= 8""")
def a2_near_images(spark, d):
    """Sign bits are the hashes; each image has a copy with 0 to 12 bits flipped, as no two vectors of a label are within 8."""
    from ..functions.vector import bit_signature

    k = F.col("vec_id")
    hashes = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), k, bit_signature(F.col("embedding")).alias("h"))
    copy = F.struct((k * 2 + 1).alias("item"), F.col("h").bitwiseXOR(F.expr("shiftleft(1L, int(vec_id % 13)) - 1")).alias("phash"))
    images = hashes.select("doc_id", F.explode(F.array(F.struct((k * 2).alias("item"), F.col("h").alias("phash")), copy)).alias("i"))
    return la.near_image_pairs(images.select("doc_id", "i.item", "i.phash"))


@query("c35_flip_box", f"WITH {fx.LINES}, {fx.ITEMS} SELECT doc_id, item, 842.0::DOUBLE - bbox[4] AS top, 842.0::DOUBLE - bbox[2] AS bottom FROM items")
def c35_flip_box(spark, d):
    box = la.flip_box(F.col("bbox"), F.lit(842.0))
    return fx.items(spark, d).select("doc_id", "item", F.get(box, F.lit(1)).alias("top"), F.get(box, F.lit(3)).alias("bottom"))


@query("r3_descendants", """WITH RECURSIVE n AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey >= 3 THEN o_orderkey // 3 END AS parent FROM orders),
  t AS (SELECT parent AS ancestor, node, 1 AS depth FROM n WHERE parent IS NOT NULL UNION ALL SELECT t.ancestor, n.node, depth + 1 FROM t JOIN n ON n.parent = t.node WHERE depth < 4)
  SELECT ancestor, node, depth FROM t""")
def r3_descendants(spark, d):
    key = F.col("o_orderkey")
    return gr.descend(table(spark, d, "orders").select(key.alias("node"), F.when(key >= 3, F.floor(key / 3)).cast(T.LongType()).alias("parent")), 4)


@query("c27_all_descendants", """WITH RECURSIVE n AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey >= 3 THEN o_orderkey // 3 END AS parent FROM orders),
  t AS (SELECT parent AS ancestor, node, 1 AS depth FROM n WHERE parent IS NOT NULL UNION ALL SELECT t.ancestor, n.node, depth + 1 FROM t JOIN n ON n.parent = t.node)
  SELECT ancestor, node, depth FROM t""")
def c27_all_descendants(spark, d):
    key = F.col("o_orderkey")
    return gr.descend(table(spark, d, "orders").select(key.alias("node"), F.when(key >= 3, F.floor(key / 3)).cast(T.LongType()).alias("parent")))
