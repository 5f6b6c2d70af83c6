"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import table
from . import fixtures as fx
from .registry import query


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _of_text(name: str, make, sql: str | None) -> None:
    """Register a function of ``documents.text``."""
    query(name, f"SELECT doc_id, {sql} AS out FROM documents" if sql else None)(
        lambda spark, d: _docs(spark, d).select("doc_id", make(F.col("text")).alias("out"))
    )


def _sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_GERMAN = "lower(text)"
for _old, _new in (("ä", "a"), ("ö", "o"), ("ü", "u"), ("ß", "ss"), ("ae", "a"), ("oe", "o"), ("ue", "u")):
    _GERMAN = f"replace({_GERMAN}, '{_old}', '{_new}')"
_CLEAN = "text"
for _p, _n in tx.CLEAN_PATTERNS:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_n}', 'g')" if _n == "" else rf"regexp_replace({_CLEAN}, '\n{{3,}}', chr(10) || chr(10), 'g')"
_SAFE = r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]|[\p{Cf}\p{Co}]', '', 'g')"
for _p in (tx.EXTERNAL_OPEN, tx.EXTERNAL_CLOSE, tx.EXTERNAL_MARK):
    _SAFE = f"replace({_SAFE}, '{_p}', '')"
for _p in tx.INJECTION_PATTERNS:
    _SAFE = "regexp_replace({}, '{}', '', 'g')".format(_SAFE, _p.replace("(?U)", "").replace(r"\w", r"[\p{L}\p{N}_]"))

_of_text("c6_normal_german", tx.normal_german, _GERMAN)
_of_text("c7_without_numbering", tx.without_numbering, _sql_strip(r"regexp_replace(text, '^[0-9.\s]+', '')"))
_of_text("c2_clean_transcription", tx.clean_transcription, _sql_strip(_CLEAN))
_of_text("c5_truncate", lambda t: tx.truncate(t, 2000), f"CASE WHEN length(text) > 2000 THEN left(text, 2000) || '{tx.TRUNCATED}' ELSE text END")
_of_text("c45_sanitized", tx.sanitized, _SAFE)
_of_text("c48_middle_cut", lambda t: tx.middle_cut(t, 1000, "[cut]"), "CASE WHEN length(text) > 995 THEN left(text, 497) || '[cut]' || right(text, 497) ELSE text END")
_of_text("c4_is_loop", tx.is_loop, None)
_of_text("c3_drop_repeated_cells", tx.drop_repeated_cells, None)
_of_text("c1_fix_mojibake", lambda t: tx.fix_mojibake(F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")), "text")
_of_text("f4_digit_free", tx.digit_free, _sql_strip("regexp_replace(text, '[0-9]+', '', 'g')"))
_of_text("a7_tokens_of_each", tx.n_tokens, rf"CASE WHEN {_sql_strip('text')} = '' THEN 0 ELSE len(regexp_split_to_array({_sql_strip('text')}, '\s+')) END")


@query("a7_average_length", rf"SELECT avg(CASE WHEN {_sql_strip('text')} = '' THEN 0 ELSE len(regexp_split_to_array({_sql_strip('text')}, '\s+')) END) AS average FROM documents")
def a7_average_length(spark, d):
    return _docs(spark, d).agg(F.avg(tx.n_tokens(F.col("text"))).alias("average"))


_FLAT = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("c40_table_text", f"SELECT page_id, CASE WHEN length({_FLAT}) > 500 THEN left({_FLAT}, 500) || '...' ELSE {_FLAT} END AS out FROM pages")
def c40_table_text(spark, d):
    return table(spark, d, "pages").select("page_id", tx.table_text(F.col("html")).alias("out"))


@query("c21_table_fragment", r"""WITH h AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN '<thead>' || html WHEN 2 THEN 'a</td></td></tr> b' ELSE ' <TR>' || html END AS html FROM pages)
  SELECT page_id, len(regexp_extract_all(html, '(?i)<tr|<td|<th')) >= 2 OR regexp_matches(html, '(?i)^\s*<(?:tr|td|th)') AS out FROM h""")
def c21_table_fragment(spark, d):
    k, html = F.col("page_id") % 4, F.col("html")
    text = F.when(k == 0, html).when(k == 1, F.concat(F.lit("<thead>"), html)).when(k == 2, "a</td></td></tr> b").otherwise(F.concat(F.lit(" <TR>"), html))
    return table(spark, d, "pages").select("page_id", tx.is_table_fragment(text).alias("out"))


@query(
    "s12_object_path",
    r"""SELECT page_id, 'document/' || (page_id % 7) || '/v1/' || regexp_replace(regexp_replace(regexp_replace(url, '[<>:"\\|?*\x00-\x1F ]', '_', 'g'), '\.{2,}', '.', 'g'), '^[ .]+|[ .]+$', '', 'g') AS out FROM pages""",
)
def s12_object_path(spark, d):
    path = tx.object_path(F.lit("document"), F.col("page_id") % 7, F.lit(1), F.col("url"))
    return table(spark, d, "pages").select("page_id", path.alias("out"))


def _archive_path(project, version, name):
    return F.concat_ws("/", F.lit("archives"), project.cast("string"), tx.safe_name(name))


tx.register_path("archive", _archive_path)


@query(
    "u7_path_by_kind",
    r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[<>:"\\|?*\x00-\x1F ]', '_', 'g'), '\.{2,}', '.', 'g'), '^[ .]+|[ .]+$', '', 'g') AS n FROM pages)
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'archives/' || (page_id % 7) || '/' || n ELSE 'document/' || (page_id % 7) || '/v1/' || n END AS out FROM s""",
)
def u7_path_by_kind(spark, d):
    kind = F.when(F.col("page_id") % 2 == 0, "archive").otherwise("document")
    return table(spark, d, "pages").select("page_id", tx.path_by_kind(kind, F.col("page_id") % 7, F.lit(1), F.col("url")).alias("out"))


@query(
    "s10_entry_name",
    r"""WITH e AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '\' END WHEN page_id % 4 = 0 THEN '__MACOSX/' || url WHEN page_id % 4 = 1 THEN '..\' || url WHEN page_id % 4 = 2 THEN '.\a\\' || url ELSE '/' || url || '/.' END AS name FROM pages),
    s AS (SELECT page_id, right(name, 1) IN ('/', '\') AS folder, list_filter(string_split(replace(name, '\', '/'), '/'), lambda p: p NOT IN ('', '.')) AS parts FROM e)
    SELECT page_id, CASE WHEN NOT folder AND len(parts) > 0 AND NOT list_contains(parts, '..') AND parts[1] <> '__MACOSX' AND NOT starts_with(array_to_string(parts, '/'), '._')
      THEN array_to_string(parts, '/') END AS out FROM s""",
)
def s10_entry_name(spark, d):
    k, url = F.col("page_id") % 4, F.col("url")
    folder = F.concat(url, F.when(F.col("page_id") % 2 == 0, "/").otherwise("\\"))
    name = F.when(F.col("page_id") % 5 == 0, folder).when(k == 0, F.concat(F.lit("__MACOSX/"), url)).when(k == 1, F.concat(F.lit("..\\"), url)).when(k == 2, F.concat(F.lit(".\\a\\\\"), url))
    return table(spark, d, "pages").select("page_id", tx.normal_entry_name(name.otherwise(F.concat(F.lit("/"), url, F.lit("/.")))).alias("out"))


_NAMES = """n AS (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Erläuterung.pdf' WHEN 2 THEN 'ERLA' || chr(776) || 'UTERUNG.PDF' WHEN 3 THEN 'Erla€uterung.pdf' ELSE 'Erlterung.docx' END AS name FROM pages)"""


def _names(spark, d):
    k = F.col("page_id") % 5
    ending = F.when(k == 0, "").when(k == 1, "Erläuterung.pdf").when(k == 2, "ERLA\u0308UTERUNG.PDF").when(k == 3, "Erla€uterung.pdf").otherwise("Erlterung.docx")
    return table(spark, d, "pages").select("page_id", F.concat("url", ending).alias("name"))


def _keyword_sql(*words: str) -> str:
    """Each word in the composed lower-case name, or its base letters in the name's ASCII characters."""
    low = "nfc_normalize(lower(name))"
    return "(" + " OR ".join(f"contains({low}, '{w}') OR contains(regexp_replace({low}, '[^\\x00-\\x7F]', '', 'g'), strip_accents('{w}'))" for w in words) + ")"


@query("f7_keywords", f"WITH {_NAMES} SELECT page_id, {_keyword_sql('utm', 'erläuterung')} AS out FROM n")
def f7_keywords(spark, d):
    return _names(spark, d).select("page_id", tx.has_keyword(F.col("name"), ["UTM", "Erläuterung"]).alias("out"))


@query("f6_triage", f"""WITH {_NAMES} SELECT page_id, CASE WHEN {_keyword_sql('utm')} THEN 'skipped' WHEN NOT regexp_matches(lower(name), '[^/.][^/]*\\.pdf$') THEN 'unsupported' WHEN {_keyword_sql('erläuterung')} THEN 'priority' ELSE 'regular' END AS kind FROM n""")
def f6_triage(spark, d):
    return _names(spark, d).select("page_id", tx.triage(F.col("name"), skipped=["utm"], extensions=[".pdf"], priority=["Erläuterung"]).alias("kind"))


@query("s11_upload_errors", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'extension' WHEN 2 THEN 'type' WHEN 3 THEN 'script' WHEN 4 THEN 'content' ELSE NULL END AS error FROM pages""")
def s11_upload_errors(spark, d):
    """Six kinds of files: a PDF, an unknown extension, a type not allowed, a script behind a byte order mark, HTML named PDF, no content."""
    k = F.col("page_id") % 6
    name = F.concat(F.col("page_id").cast("string"), F.when(k == 1, ".exe").when(k == 2, ".TXT").otherwise(".PDF"))
    head = F.when(k == 3, F.unhex(F.lit("EFBBBF23212F62"))).when(k == 4, F.encode("html", "UTF-8")).when(k < 3, F.encode(F.concat(F.lit("%PDF-1.7 "), "html"), "UTF-8"))
    types = {".pdf": "application/pdf", ".txt": "text/plain"}
    return table(spark, d, "pages").select("page_id", tx.upload_error(name, head, types, ["application/pdf"]).alias("error"))


@query("c36_safe_stem", """SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(text || chr(8232) || 'u' || chr(776) || '?' || chr(9)), '[\\x00-\\x08\\x0a-\\x1f\\x7f-\\x9f]|[\\p{Cf}\\p{Zl}\\p{Zp}]', '', 'g'), '[<>:"|?*]', '_', 'g') AS out FROM documents""")
def c36_safe_stem(spark, d):
    name = F.concat("text", F.lit("\u2028u\u0308?\t"))
    return _docs(spark, d).select("doc_id", tx.safe_stem(name).alias("out"))


@query("c39_summaries_only", """SELECT doc_id, 'a ' || CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END || ' b ' || CASE WHEN doc_id % 3 = 0 THEN text ELSE 'cell' END || ' c' AS out FROM documents WHERE text IS NOT NULL""")
def c39_summaries_only(spark, d):
    """A figure with and without a summary, a table with a summary or else its text."""
    k, text = F.col("doc_id"), F.col("text")
    figure = F.concat(F.lit("<BILD x><content>z</content>"), F.when(k % 2 == 0, F.concat(F.lit("<summary>"), text, F.lit("</summary>"))).otherwise(""), F.lit("</BILD>"))
    table_ = F.concat(F.lit("<TABELLE>"), F.when(k % 3 == 0, F.concat(F.lit("<summary>"), text, F.lit("</summary>"))).otherwise("<td> cell </td>"), F.lit("</TABELLE>"))
    return _docs(spark, d).where("text is not null").select("doc_id", tx.summaries_only(F.concat(F.lit("a "), figure, F.lit(" b "), table_, F.lit(" c"))).alias("out"))


@query("c47_rendered", f"SELECT doc_id, 'Text: ' || {_SAFE} || ' {{end}} <¤EXTERNAL_DATA¤>' AS out FROM documents WHERE text IS NOT NULL")
def c47_rendered(spark, d):
    out = tx.rendered("Text: {text} {{end}} {external_data_tag_open}", text=F.col("text"))
    return _docs(spark, d).where("text is not null").select("doc_id", out.alias("out"))


@query("t6_windows", "SELECT doc_id, i::INT AS part, substr(text, i * 1000 + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) AS i FROM documents)")
def t6_windows(spark, d):
    from ..operators.services import windows

    return _docs(spark, d).select("doc_id", F.posexplode(windows(F.col("text"), 1000)).alias("part", "text"))


@query("c28_pages_of_text", r"""WITH m AS (SELECT doc_id, '<seite nummer="' || (doc_id % 9) || '" />' || text || '<seite  nummer="12"/>' AS t FROM documents)
  SELECT doc_id, array_to_string(regexp_extract_all(t, '<seite\s+nummer="(\d+)"\s*/>', 1), ',') AS out FROM m""")
def c28_pages_of_text(spark, d):
    marked = F.concat(F.lit('<seite nummer="'), (F.col("doc_id") % 9).cast("string"), F.lit('" />'), F.col("text"), F.lit('<seite  nummer="12"/>'))
    return _docs(spark, d).select("doc_id", F.array_join(tx.page_numbers(marked).cast("array<string>"), ",").alias("out"))


@query("c26_header_level", r"""SELECT p_partkey, CASE WHEN n = '' THEN 1 ELSE len(string_split(n, '.')) END::INT AS level FROM
  (SELECT p_partkey, regexp_replace(regexp_extract(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE (p_partkey % 9) || '.' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.1. ' ELSE '. ' END || p_name END, '^([0-9.]+)', 1), '^\.+|\.+$', '', 'g') AS n FROM part)""")
def c26_header_level(spark, d):
    tail = F.when(F.col("p_partkey") % 2 == 0, F.lit(".1. ")).otherwise(F.lit(". "))
    numbered = F.concat((F.col("p_partkey") % 9).cast("string"), F.lit("."), F.col("p_size").cast("string"), tail, F.col("p_name"))
    title = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(numbered)
    return table(spark, d, "part").select("p_partkey", tx.header_level(title).alias("level"))


@query("c57_statement_kind", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'DELETE' WHEN 3 THEN 'CREATE' ELSE 'OTHER' END AS kind FROM orders""")
def c57_statement_kind(spark, d):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "  insert into t").when(k == 1, "Update t set").when(k == 2, " DELETE from").when(k == 3, "create table").otherwise("select 1")
    return table(spark, d, "orders").select("o_orderkey", tx.statement_kind(text).alias("kind"))


@query("c50_chunk_text", f"""WITH {fx.CHUNKS} SELECT chunk_id, CASE WHEN chunk_type = 'text' THEN {_sql_strip('text')}
  WHEN seq % 2 = 0 THEN '' ELSE '[SUMMARY]' || chr(10) || {_sql_strip('text')} || chr(10) || '[/SUMMARY]' END AS out FROM chunks""")
def c50_chunk_text(spark, d):
    summary = F.when(F.col("seq") % 2 == 1, F.col("text"))
    return fx.chunks(spark, d).select("chunk_id", tx.chunk_text(F.col("chunk_type"), F.col("text"), summary).alias("out"))


@query("c11_plain_symbols", r"""WITH m AS (SELECT doc_id, '$\S$ 3 $5^{circ}C$ $5^{\circ}$' || text || ' $\S$ $7^{circ}F$' AS t FROM documents)
  SELECT doc_id, replace(regexp_replace(t, '\$([^$]*)\^\{circ\}([^$]*)\$', '\1°\2', 'g'), '$\S$', '§') AS out FROM m""")
def c11_plain_symbols(spark, d):
    text = F.concat(F.lit("$\\S$ 3 $5^{circ}C$ $5^{\\circ}$"), F.col("text"), F.lit(" $\\S$ $7^{circ}F$"))
    return _docs(spark, d).select("doc_id", tx.plain_symbols(text).alias("out"))


@query("c46_wrapped", f"SELECT doc_id, '<¤EXTERNAL_DATA¤>' || chr(10) || {_SAFE} || chr(10) || '</¤EXTERNAL_DATA¤>' AS out FROM documents")
def c46_wrapped(spark, d):
    return _docs(spark, d).select("doc_id", tx.wrapped(F.col("text")).alias("out"))


@query("c51_table_content", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_sql_strip('text')} ELSE text END AS out FROM documents")
def c51_table_content(spark, d):
    tagged = F.concat(F.lit("before <table_content> "), F.col("text"), F.lit(" </TABLE_CONTENT> after"))
    return _docs(spark, d).select("doc_id", tx.table_content(F.when(F.col("doc_id") % 2 == 0, tagged).otherwise(F.col("text"))).alias("out"))


@query("c55_output_folder", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'name' || doc_id WHEN doc_id % 3 = 1 THEN 'a.b/c/name.x' || doc_id ELSE 'a.b/name' END AS out FROM documents")
def c55_output_folder(spark, d):
    k, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    name = F.when(k == 0, F.concat(F.lit("name"), n, F.lit(".pdf"))).when(k == 1, F.concat(F.lit("a.b/c/name.x"), n, F.lit(".pdf"))).otherwise(F.lit("a.b/name"))
    return _docs(spark, d).select("doc_id", tx.output_folder(name).alias("out"))


@query("c58_mapped_keys", "SELECT event_id, event_type AS kind, user_id::VARCHAR AS other FROM events")
def c58_mapped_keys(spark, d):
    context = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    mapped = tx.mapped_keys(context, {"type": "event.kind"})
    return table(spark, d, "events").select("event_id", mapped["event.kind"].alias("kind"), mapped["user"].alias("other"))
