"""Enrichment, folds and model columns over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import models
from ..functions.vector import bit_signature
from ..operators import chunks as ch
from ..operators import enrich as en
from ..operators import folds
from ..operators import layout as la
from ..sources.tables import table
from . import fixtures as fx
from .registry import query


@query("j13_merge_metadata", f"""WITH {fx.CHUNKS} SELECT chunk_id, CASE WHEN seq % 2 = 0 THEN 'topic-' || seq ELSE toc_path END AS toc_path, CASE WHEN seq % 3 = 0 THEN seq END AS scale FROM chunks""")
def j13_merge_metadata(spark, d):
    c = fx.chunks(spark, d)
    topics = c.where("seq % 2 = 0").select("chunk_id", F.concat(F.lit("topic-"), F.col("seq").cast("string")).alias("toc_path"))
    scales = c.where("seq % 3 = 0").select("chunk_id", F.col("seq").alias("scale"))
    return en.merge_metadata(c.select("chunk_id", "toc_path"), topics, scales).select("chunk_id", "toc_path", "scale")


@query("j14_merge_by_position", f"WITH {fx.CHUNKS} SELECT document_id, seq, CASE WHEN seq % 2 = 0 THEN 'topic-' || seq ELSE toc_path END AS toc_path FROM chunks")
def j14_merge_by_position(spark, d):
    c = fx.chunks(spark, d)
    topics = c.where("seq % 2 = 0").select("document_id", "seq", F.concat(F.lit("topic-"), F.col("seq").cast("string")).alias("toc_path"))
    return en.merge_metadata(c.select("document_id", "seq", "toc_path"), topics, keys=("document_id", "seq")).select("document_id", "seq", "toc_path")


@query("c56_index_points", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
  SELECT 'chunk' AS point_type, doc_id::VARCHAR AS id, array_to_string(p, chr(10)) AS text FROM l WHERE len(p) = 1
  UNION ALL SELECT 'chunk', doc_id || '/' || unnest(range(0, len(p))), unnest(p) FROM l WHERE len(p) > 1
  UNION ALL SELECT 'parent_chunk', doc_id::VARCHAR, array_to_string(p, chr(10)) FROM l WHERE len(p) > 1
  UNION ALL SELECT 'question', doc_id || '#' || unnest([0, 1]), unnest(['who', 'what']) FROM l""")
def c56_index_points(spark, d):
    key = F.col("doc_id").cast("string")
    parts = F.split("text", "\n")
    subs = F.transform(parts, lambda x, i: F.struct(F.concat(key, F.lit("/"), i.cast("string")).alias("chunk_id"), x.alias("text")))
    chunks = table(spark, d, "documents").select(
        key.alias("chunk_id"), "text", F.array(F.lit("who"), F.lit("what")).alias("questions"), F.when(F.size(parts) > 1, subs).otherwise(F.slice(subs, 1, 0)).alias("sub_chunks")
    )
    return en.index_points(chunks)


@query("s21_upsert_summary", """WITH o AS (SELECT doc_id, doc_id % 7 AS d, doc_id AS pos FROM documents WHERE doc_id % 3 < 2), n AS (SELECT doc_id, doc_id % 5 AS d, doc_id AS pos FROM documents WHERE doc_id % 3 > 0), t AS (SELECT max(pos) AS top FROM o)
  SELECT coalesce(o.doc_id, n.doc_id)::VARCHAR AS document_name, CASE WHEN n.doc_id IS NOT NULL THEN 'new' ELSE 'old' END AS summary, coalesce(o.d, 0) + coalesce(n.d, 0) AS duration, coalesce(o.pos, top + 1 + n.pos) AS pos FROM o FULL JOIN n USING (doc_id), t""")
def s21_upsert_summary(spark, d):
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    side = lambda name, m: docs.select(k.cast("string").alias("document_name"), F.lit(name).alias("summary"), (k % m).alias("duration"), k.alias("pos"))
    return en.upsert_summary(side("old", 7).where("pos % 3 < 2"), side("new", 5).where("pos % 3 > 0"))


#: The rounds in SQL: fours are joined while a text of more than one part is over the limit.
_ROUNDS = """WITH RECURSIVE p AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
  s AS (SELECT doc_id, pos, left(line, 40) || '~' AS text FROM p),
  r AS (SELECT doc_id, 0 AS round, list(text ORDER BY pos) AS parts FROM s GROUP BY doc_id
    UNION ALL SELECT doc_id, round + 1, list_transform(range(0, (len(parts) + 3) // 4), lambda i: '[' || array_to_string(parts[i * 4 + 1:i * 4 + 4], chr(10)) || ']') FROM r
    WHERE len(parts) > 1 AND list_sum(list_transform(parts, lambda x: length(x))) > 300)"""


@query("a12_join_in_blocks", f"{_ROUNDS} SELECT doc_id AS document_id, array_to_string(arg_max(parts, round), chr(10)) AS text FROM r GROUP BY doc_id")
def a12_join_in_blocks(spark, d):
    """Every line is cut and marked by its summary; every block of four that a round joins is in brackets, which shows the rounds."""
    said = F.concat(F.substring("line", 1, 40), F.lit("~"))
    lines = fx.lines(spark, d).select(F.col("doc_id").alias("document_id"), F.col("pos").cast("long").alias("pos"), said.alias("text"))
    return en.join_in_blocks(lines, most=300, condense=lambda t: F.concat(F.lit("["), t, F.lit("]")))


@query("j21_furniture_tables", f"""WITH {fx.LINES}, f AS (SELECT doc_id, line FROM lines WHERE pos % 3 = 0 AND line <> ''), c AS (SELECT doc_id, pos // 4 AS table_id, line || CASE WHEN pos % 2 = 0 THEN '' ELSE ' #' END AS cell FROM lines)
  SELECT doc_id, table_id::INT AS table_id FROM c WHERE trim(cell) <> '' AND doc_id IN (SELECT doc_id FROM f) GROUP BY ALL HAVING avg((EXISTS (SELECT 1 FROM f WHERE f.doc_id = c.doc_id AND contains(f.line, c.cell)))::INT) > 0.5""")
def j21_furniture_tables(spark, d):
    lines = fx.lines(spark, d)
    cells = lines.select("doc_id", F.floor(F.col("pos") / 4).cast("int").alias("table_id"), F.concat("line", F.when(F.col("pos") % 2 == 0, "").otherwise(" #")).alias("cell"))
    return en.furniture_tables(cells, lines.where("pos % 3 = 0").select("doc_id", F.col("line").alias("text")))


@query("c41_topic_names", """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 30 - 1 = -1 THEN 'Unsicher' ELSE coalesce(n_name, 'Invalid ID') END AS topic_name FROM lineitem LEFT JOIN nation ON n_nationkey = l_suppkey % 30 - 1""")
def c41_topic_names(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 30 - 1).alias("topic_id"))
    topics = table(spark, d, "nation").select(F.col("n_nationkey").alias("topic_id"), F.col("n_name").alias("name"))
    return en.topic_names(rows, topics).select("l_orderkey", "l_linenumber", "topic_name")


@query("t7_top_questions", """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:3], '|') AS questions FROM documents""")
def t7_top_questions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(en.top_questions(F.split("text", "\n")), "|").alias("questions"))


@query("f8_eligible_chunks", f"WITH {fx.CHUNKS} SELECT chunk_id FROM chunks WHERE length(text) >= 50 AND chunk_type <> 'image'")
def f8_eligible_chunks(spark, d):
    return en.eligible_chunks(fx.chunks(spark, d)).select("chunk_id")


_HEADS = rf"""{fx.MARKDOWN}, hl AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS text FROM md),
  heads AS (SELECT doc_id, line, length(regexp_extract(text, '^(#{{1,6}})\s+\S', 1)) AS level, length(text) AS tokens FROM hl WHERE regexp_matches(text, '^#{{1,6}}\s+\S'))"""


@query("a11_subtree_tokens", f"""WITH {_HEADS}, e AS (SELECT h.*, (SELECT min(o.line) FROM heads o WHERE o.doc_id = h.doc_id AND o.line > h.line AND o.level <= h.level) AS stop FROM heads h)
  SELECT e.doc_id, e.line::INT AS line, (SELECT sum(o.tokens) FROM heads o WHERE o.doc_id = e.doc_id AND o.line >= e.line AND (e.stop IS NULL OR o.line < e.stop))::BIGINT AS total_tokens FROM e""")
def a11_subtree_tokens(spark, d):
    docs = fx.markdown(spark, d)
    text = F.element_at(F.split("markdown", "\n"), F.col("line"))
    nodes = ch.header_nodes(docs).join(docs, "doc_id").select("doc_id", "line", "level", F.length(text).alias("tokens"))
    return en.subtree_tokens(nodes).select("doc_id", "line", "total_tokens")


@query("c34_grid_html", """WITH c AS (SELECT o_custkey AS table_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row, o_orderpriority AS a, o_orderstatus AS b FROM orders)
  SELECT table_id, '<table>' || string_agg('<tr>' || CASE WHEN row % 3 = 0 THEN '<th colspan="2">' || a || '</th>' ELSE '<td>' || a || '</td>' || CASE WHEN row % 3 = 1 THEN '<td>&lt;' || b || '&amp;</td>' ELSE '<td></td>' END END || '</tr>', '' ORDER BY row) || '</table>' AS html
  FROM c WHERE table_id IN (SELECT table_id FROM c WHERE row > 0) GROUP BY table_id""")
def c34_grid_html(spark, d):
    from pyspark.sql.window import Window

    rank = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("row")
    base = table(spark, d, "orders").select(F.col("o_custkey").alias("table_id"), rank, F.col("o_orderpriority").alias("a"), F.concat(F.lit("<"), "o_orderstatus", F.lit("&")).alias("b"))
    head = F.col("row") % 3 == 0
    one = F.lit(1)
    first = base.select("table_id", "row", F.lit(0).alias("col"), one.alias("row_span"), F.when(head, 2).otherwise(1).alias("col_span"), head.alias("header"), F.col("a").alias("text"))
    second = base.where("row % 3 = 1").select("table_id", "row", one.alias("col"), one.alias("row_span"), one.alias("col_span"), F.lit(False).alias("header"), F.col("b").alias("text"))
    several = base.where("row > 0").select("table_id").distinct()
    return en.grid_html(first.unionByName(second).join(several, "table_id", "left_semi"))


@query("c19_split_text")
def c19_split_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(folds.split_column(2000)(F.col("text"))).alias("part", "text"))


@query("c9_split_oversized", f"""WITH RECURSIVE {fx.cut_sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL", "doc_id", 3000)} SELECT doc_id, n::INT AS part, piece AS text FROM cut WHERE n >= 0""")
def c9_split_oversized(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(folds.oversized_column(3000)(F.col("text"))).alias("part", "text"))


@query("a2_image_leaders")
def a2_image_leaders(spark, d):
    """Sign bits of the vectors are the hashes, a label is the document; the production distance of 8.

    No two vectors of a label are that near, so each image has a copy with 0 to 12 bits flipped.
    """
    k = F.col("vec_id")
    hashes = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), k, bit_signature(F.col("embedding")).alias("h"))
    copy = F.struct((k * 2 + 1).alias("item"), F.col("h").bitwiseXOR(F.expr("shiftleft(1L, int(vec_id % 13)) - 1")).alias("phash"))
    images = hashes.select("doc_id", F.explode(F.array(F.struct((k * 2).alias("item"), F.col("h").alias("phash")), copy)).alias("i"))
    return la.image_leaders(images.select("doc_id", "i.item", "i.phash"))


@query("j15_match_enrichment")
def j15_match_enrichment(spark, d):
    c = fx.chunks(spark, d).withColumn("pages", F.array((F.col("seq") / 2).cast("int"))).withColumn("seq", F.col("seq").cast("int"))
    return folds.match_enrichment(c, c.where("seq % 2 = 0"))


@query("u3_embeddings")
def u3_embeddings(spark, d):
    embed = models.model_column(models.hashed_embedding, T.ArrayType(T.DoubleType()))
    return table(spark, d, "documents").select("doc_id", embed(F.col("text")).alias("embedding"))


@query("u1_summaries")
def u1_summaries(spark, d):
    return table(spark, d, "documents").select("doc_id", models.model_column(models.first_sentence, T.StringType())(F.col("text")).alias("summary"))
