"""The provided tables seen as the engine's own: files, claims, chunks, elements, types, events.

Each view has the same definition as SQL, as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import dealt_for_join, table

FILES = """files AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN 'archive' ELSE 'document' END AS type,
    'part-' || (l_partkey % 50) || '.pdf' AS filename, l_linenumber AS version, o_custkey % 20 AS project_id,
    'p' || (o_custkey % 20) || '/part-' || (l_partkey % 50) || '.pdf' AS bucket_path, l_linestatus = 'F' AS deleted,
    l_shipdate AS created_at, l_quantity AS size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = dealt_for_join(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders"), "o_orderkey")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.concat(F.lit("part-"), (F.col("l_partkey") % 50).cast("string"), F.lit(".pdf"))
    project = F.col("o_custkey") % 20
    return both.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_returnflag") == "R", "archive").otherwise("document").alias("type"),
        name.alias("filename"),
        F.col("l_linenumber").alias("version"),
        project.alias("project_id"),
        F.concat(F.lit("p"), project.cast("string"), F.lit("/"), name).alias("bucket_path"),
        (F.col("l_linestatus") == "F").alias("deleted"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_quantity").alias("size"),
    )


CLAIMS = """claims AS (
  SELECT vec_id AS claim_id, 0 AS project_id, label AS document_id, vec_id AS seq, vec_id % 10 = 0 AS priority, embedding::DOUBLE[] AS vector FROM embeddings)"""


def claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("claim_id"),
        F.lit(0).alias("project_id"),
        F.col("label").alias("document_id"),
        F.col("vec_id").alias("seq"),
        (F.col("vec_id") % 10 == 0).alias("priority"),
        F.col("embedding").alias("vector"),
    )


CHUNKS = """chunks AS (
  SELECT conv_id AS document_id, turn AS seq, conv_id || '-' || turn AS chunk_id, text, role AS toc_path,
    CASE WHEN role = 'user' THEN 'text' ELSE 'image' END AS chunk_type FROM conversations)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("document_id"),
        F.col("turn").alias("seq"),
        F.concat_ws("-", "conv_id", "turn").alias("chunk_id"),
        "text",
        F.col("role").alias("toc_path"),
        F.when(F.col("role") == "user", "text").otherwise("image").alias("chunk_type"),
    )


LINES = """lines AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"""

MARKDOWN = """md AS (
  SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 4 WHEN 0 THEN '# ' || x
    WHEN 2 THEN '## ' || x ELSE x END) AS lines FROM documents)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth line a heading, the second after it a subheading."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 4 == 0, "# ").when(i % 4 == 2, "## ").otherwise(""), x))
    return table(spark, d, "documents").select("doc_id", F.array_join(marked, "\n").alias("markdown"))


PAGED = """paged AS (
  SELECT doc_id, string_agg(CASE WHEN (pos - 1) % 3 = 2 THEN '<seite nummer="' || ((pos + 2) // 3) || '" />' || chr(10) ELSE '' END
    || CASE (pos - 1) % 4 WHEN 0 THEN '# ' || line WHEN 2 THEN '## ' || line ELSE line END, chr(10) ORDER BY pos) AS markdown
  FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id)"""


def paged(spark: SparkSession, d: str) -> DataFrame:
    """As ``markdown``, with a page mark before every third line from the third on."""
    mark = lambda i: F.when(i % 3 == 2, F.concat(F.lit('<seite nummer="'), F.floor((i + 3) / 3).cast("string"), F.lit('" />\n'))).otherwise("")
    head = lambda i: F.when(i % 4 == 0, "# ").when(i % 4 == 2, "## ").otherwise("")
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(mark(i), head(i), x))
    return table(spark, d, "documents").select("doc_id", F.array_join(marked, "\n").alias("markdown"))


def cut_sql(rows: str, keys: str, most: int) -> str:
    """Recursive table ``cut`` (keys, n, piece): texts of ``rows`` (keys, text) in parts of ``most``, cut after blank lines or line ends beyond a quarter."""
    last = lambda mark: f"CASE WHEN instr(reverse(left(rest, {most})), {mark}) = 0 THEN -1 ELSE {most} - instr(reverse(left(rest, {most})), {mark}) - length({mark}) + 1 END"
    two, one = last("chr(10) || chr(10)"), last("chr(10)")
    at = f"CASE WHEN length(rest) <= {most} THEN length(rest) WHEN {two} > {most // 4} THEN {two} + 2 WHEN {one} > {most // 4} THEN {one} + 1 ELSE {most} END"
    return f"""cut AS (SELECT {keys}, -1 AS n, text AS rest, NULL::VARCHAR AS piece FROM ({rows})
  UNION ALL SELECT {keys}, n + 1, CASE WHEN length(rest) <= {most} THEN NULL ELSE substr(rest, ({at}) + 1) END, left(rest, {at}) FROM cut WHERE rest IS NOT NULL AND (n < 0 OR rest <> ''))"""


ITEMS = """items AS (
  SELECT doc_id, pos::INT AS item, (pos // 5)::INT AS page, (CASE pos % 4 WHEN 1 THEN 'table' WHEN 2 THEN 'image' ELSE 'text' END) AS type,
    line AS text, line AS table_body, (pos % 3)::BIGINT AS phash, [0.0, ((pos * 97) % 842)::DOUBLE, 100.0, ((pos * 97) % 842)::DOUBLE + 10] AS bbox,
    CASE WHEN pos % 9 = 0 THEN 'Page_Header' ELSE 'text' END AS label, CASE WHEN pos % 13 = 0 THEN 'furniture' END AS layer FROM lines)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    y = ((F.col("pos") * 97) % 842).cast("double")
    kind = F.when(F.col("pos") % 4 == 1, "table").when(F.col("pos") % 4 == 2, "image").otherwise("text")
    return lines(spark, d).select(
        "doc_id",
        F.col("pos").alias("item"),
        F.floor(F.col("pos") / 5).cast("int").alias("page"),
        kind.alias("type"),
        F.col("line").alias("text"),
        F.col("line").alias("table_body"),
        (F.col("pos") % 3).cast("long").alias("phash"),
        F.array(F.lit(0.0), y, F.lit(100.0), y + 10).alias("bbox"),
        F.when(F.col("pos") % 9 == 0, "Page_Header").otherwise("text").alias("label"),
        F.when(F.col("pos") % 13 == 0, "furniture").alias("layer"),
    )


TYPES = """types AS (SELECT p_partkey AS type_id, p_size % 12 AS category_id, p_name AS type_name, p_partkey % 5 = 0 OR p_size % 12 = 3 AS deleted FROM part)"""
ASSIGNED = """assigned AS (SELECT l_orderkey * 10 + l_linenumber AS document_id, CASE WHEN l_linenumber > 1 AND l_partkey % 3 > 0 THEN l_partkey END AS type_id,
  CASE WHEN l_linenumber % 3 > 0 THEN l_discount END AS confidence, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS reasoning FROM lineitem)"""


def types(spark: SparkSession, d: str) -> DataFrame:
    category = F.col("p_size") % 12
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("type_id"),
        category.alias("category_id"),
        F.col("p_name").alias("type_name"),
        ((F.col("p_partkey") % 5 == 0) | (category == 3)).alias("deleted"),
    )


def assigned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("document_id"),
        F.when((F.col("l_linenumber") > 1) & (F.col("l_partkey") % 3 > 0), F.col("l_partkey")).alias("type_id"),
        F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount")).alias("confidence"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("reasoning"),
    )


EVENTS = """ev AS (SELECT user_id::VARCHAR AS workflow_id, (event_id % 5)::VARCHAR AS ref, event_id, ts, value, props AS message, user_id,
  CASE event_type WHEN 'signup' THEN 'scheduled' WHEN 'click' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'noise' END AS event_type FROM events)"""


def job_events(events: DataFrame) -> DataFrame:
    """The ``events`` table, batch or stream, as job events."""
    kind = F.col("event_type")
    name = F.when(kind == "signup", "scheduled").when(kind == "click", "started").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("noise")
    return events.select(
        F.col("user_id").cast("string").alias("workflow_id"),
        (F.col("event_id") % 5).cast("string").alias("ref"),
        "event_id",
        "ts",
        "value",
        F.col("props").alias("message"),
        "user_id",
        name.alias("event_type"),
    )
