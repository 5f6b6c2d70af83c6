"""Reads and changes of the services, over the provided tables seen as theirs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import models
from ..operators import services as sv
from ..sources import archives as ar
from ..sources import bucketed as bk
from ..sources import documents as dc
from ..sources import tables as tb
from ..sources.tables import table
from . import fixtures as fx
from .registry import query
from .staging import new_path, stage

COMMENTS = """comments AS (SELECT event_id AS id, user_id % 5 AS project_id, event_type AS process_step, CASE event_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'file' ELSE 'note' END AS source_type, ts AS created_at FROM events)"""


def _comments(spark, d):
    k = F.col("event_id") % 3
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("project_id"), F.col("event_type").alias("process_step"),
        F.when(k == 0, "manual").when(k == 1, "file").otherwise("note").alias("source_type"), F.col("ts").alias("created_at"),
    )


@query("f12_list_comments", f"WITH {COMMENTS} SELECT id FROM comments WHERE project_id = 2 AND process_step IN ('click', 'view') AND source_type IN ('manual', 'file') ORDER BY created_at, id LIMIT 30 OFFSET 10")
def f12_list_comments(spark, d):
    return sv.list_comments(_comments(spark, d), 2, steps=["click", "view"], sources=["manual", "file"], offset=10, limit=30).select("id")


DEADLINES = "deadlines AS (SELECT o_orderkey AS id, o_custkey % 20 AS project_id, o_orderdate AS end_at FROM orders)"


@query("f13_list_deadlines", f"WITH {DEADLINES} SELECT id, end_at FROM deadlines WHERE project_id = 7")
def f13_list_deadlines(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("project_id"), F.col("o_orderdate").alias("end_at"))
    return sv.list_deadlines(rows, 7).select("id", "end_at")


STEPS = "steps AS (SELECT p_partkey AS step_id, p_size % 5 AS type_id, p_partkey % 4 AS step_index FROM part), kinds AS (SELECT r_regionkey AS type_id, r_name AS type_name FROM region WHERE r_regionkey <> 3)"


def _steps(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("step_id"), (F.col("p_size") % 5).alias("type_id"), (F.col("p_partkey") % 4).alias("step_index"))


@query("f14_list_steps", f"WITH {STEPS} SELECT step_id FROM steps WHERE type_id = 2")
def f14_list_steps(spark, d):
    return sv.list_steps(_steps(spark, d), 2).select("step_id")


@query("j4_step_ids", f"WITH {STEPS}, w AS (SELECT n_nationkey, r_name AS type_name, n_nationkey % 4 AS step_index FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT n_nationkey, step_id FROM w LEFT JOIN (SELECT * FROM steps JOIN kinds USING (type_id)) s ON s.type_name = w.type_name AND s.step_index = w.step_index")
def j4_step_ids(spark, d):
    regions = table(spark, d, "region")
    kinds = regions.where("r_regionkey <> 3").select(F.col("r_regionkey").alias("type_id"), F.col("r_name").alias("type_name"))
    wanted = table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    wanted = wanted.select("n_nationkey", F.col("r_name").alias("type_name"), (F.col("n_nationkey") % 4).alias("step_index"))
    return sv.step_id(_steps(spark, d), kinds, wanted).select("n_nationkey", "step_id")


ARCHIVES = "archives AS (SELECT o_orderkey AS id, o_custkey % 20 AS project_id, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'OPEN' ELSE 'RUNNING' END AS workflow_status, o_orderdate AS created_at FROM orders)"


def _archives(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("RUNNING")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("project_id"), status.alias("workflow_status"), F.col("o_orderdate").alias("created_at"))


@query("f15_list_archives", f"WITH {ARCHIVES} SELECT id FROM archives WHERE project_id = 3 AND workflow_status = 'OPEN' ORDER BY created_at DESC, id DESC LIMIT 5 OFFSET 5")
def f15_list_archives(spark, d):
    rows = _archives(spark, d).withColumnRenamed("workflow_status", "status")
    return sv.list_archives(rows, project=3, status="OPEN", offset=5, limit=5).select("id")


@query("f16_by_id", f"WITH {fx.FILES} SELECT id, filename FROM files WHERE id = 11 AND NOT deleted")
def f16_by_id(spark, d):
    return sv.by_id(fx.files(spark, d), "id", 11, include_deleted=False).select("id", "filename")


@query("m15_by_ids", "SELECT k AS o_custkey, count(o_orderkey) AS n, CASE count(o_orderkey) WHEN 0 THEN 'missing' WHEN 1 THEN NULL ELSE 'ambiguous' END AS error FROM (SELECT c_custkey AS k FROM customer) c LEFT JOIN orders ON o_custkey = k GROUP BY k")
def m15_by_ids(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return sv.by_ids(table(spark, d, "orders"), wanted, "o_custkey").select("o_custkey", "n", "error")


@query("j8_notes_with_places", """SELECT c_custkey AS note_id, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey), '') AS occurrences FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 4 GROUP BY c_custkey""")
def j8_notes_with_places(spark, d):
    notes = table(spark, d, "customer").select(F.col("c_custkey").alias("note_id"), F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("created_at"))
    places = table(spark, d, "orders").select(F.col("o_custkey").alias("note_id"), F.col("o_orderkey").alias("chunk"), F.col("o_orderstatus").alias("kind"))
    shown = F.array_join(F.transform("occurrences", lambda x: F.concat_ws(":", x["chunk"], x["kind"])), ",")
    return sv.notes_with_places(notes, places, 4).select("note_id", shown.alias("occurrences"))


@query("t8_newest_notes", "SELECT o_orderkey AS note_id FROM orders WHERE o_custkey = 7")
def t8_newest_notes(spark, d):
    notes = table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("created_at"))
    return sv.newest_notes(notes, 7).select("note_id")


@query("j22_file_assignments", f"WITH {fx.ASSIGNED} SELECT document_id, document_id % 1000 AS file_id, type_id FROM assigned WHERE document_id % 3 > 0")
def j22_file_assignments(spark, d):
    file_id = F.when(F.col("document_id") % 3 > 0, F.col("document_id") % 1000)
    return sv.file_assignments(fx.assigned(spark, d).withColumn("file_id", file_id))


@query("j18_priority_documents", """WITH e AS (SELECT o_custkey AS classification, o_orderkey, o_orderpriority AS name, list_sort(list(l_partkey)) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
  SELECT classification, unnest(ids) AS document_id FROM (SELECT * FROM e WHERE name = '1-URGENT' QUALIFY row_number() OVER (PARTITION BY classification ORDER BY o_orderkey) = 1)""")
def j18_priority_documents(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_partkey")).alias("document_ids"))
    entries = table(spark, d, "orders").join(lines, "o_orderkey").groupBy(F.col("o_custkey").alias("classification"))
    entries = entries.agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("name"), "document_ids"))).alias("entries"))
    return sv.priority_documents(entries, "1-URGENT")


@query("a19_processing_totals", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id")
def a19_processing_totals(spark, d):
    return sv.processing_totals(table(spark, d, "events").withColumn("error", F.when(F.col("event_type") == "error", "x")), "user_id")


@query("a20_evidence", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 2 = 0 OR l_partkey % 5 = 0")
def a20_evidence(spark, d):
    rows = table(spark, d, "lineitem").withColumn("a", F.when(F.col("l_linenumber") % 2 == 0, "x")).withColumn("b", F.when(F.col("l_partkey") % 5 == 0, "y"))
    return sv.evidence(rows, ["a", "b"]).select("l_orderkey", "l_linenumber")


@query("a21_grouped_documents", "SELECT p_partkey AS document_id, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS representative, CASE WHEN min(p_partkey) OVER (PARTITION BY p_brand, p_size) % 2 = 0 THEN min(p_partkey) OVER (PARTITION BY p_brand, p_size) END AS type_id FROM part")
def a21_grouped_documents(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("document_id"), "p_brand", "p_size")
    grouped = sv.grouped_documents(docs, ["p_brand", "p_size"])
    matches = grouped.where("is_representative and document_id % 2 = 0").select("document_id", F.col("document_id").alias("type_id"))
    return sv.representative_matches(docs, matches, ["p_brand", "p_size"]).join(grouped.select("document_id", "representative"), "document_id").select("document_id", "representative", "type_id")


@query("a17_delete_project", f"WITH {fx.TYPES}, {fx.ASSIGNED} SELECT (SELECT count(*) FROM types WHERE category_id = 4) AS deleted_types, (SELECT count(*) FROM assigned WHERE document_id % 12 = 4 AND type_id IS NULL) AS deleted_documents")
def a17_delete_project(spark, d):
    types, docs = fx.types(spark, d).withColumn("project_id", F.col("category_id")), fx.assigned(spark, d).withColumn("project_id", F.col("document_id") % 12)
    return sv.delete_project(types, docs, 4)[2]


_CHANGES = "ch AS (SELECT DISTINCT document_id AS file_id, CASE document_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 99999999 END::BIGINT AS type_id FROM assigned WHERE document_id % 7 = 0)"


def _overrides(spark, d):
    docs = fx.assigned(spark, d).select(F.col("document_id").alias("file_id"), "type_id")
    k = F.col("file_id") % 4
    changes = docs.where("file_id % 7 = 0").select("file_id", F.when(k == 0, F.lit(None)).when(k == 1, F.lit(1)).otherwise(F.lit(99_999_999)).cast("long").alias("type_id")).distinct()
    return sv.override_assignments(docs, changes, fx.types(spark, d))


@query("x8_override_assignments", f"WITH {fx.ASSIGNED}, {_CHANGES} SELECT a.document_id AS file_id, CASE WHEN c.file_id IS NOT NULL AND (c.type_id IS NULL OR c.type_id IN (SELECT p_partkey FROM part)) THEN c.type_id ELSE a.type_id END AS type_id FROM assigned a LEFT JOIN ch c ON c.file_id = a.document_id")
def x8_override_assignments(spark, d):
    return _overrides(spark, d)[0]


@query("x8_refused", f"WITH {fx.ASSIGNED}, {_CHANGES} SELECT file_id, type_id, 'unknown type' AS error FROM ch WHERE type_id IS NOT NULL AND type_id NOT IN (SELECT p_partkey FROM part)")
def x8_refused(spark, d):
    return _overrides(spark, d)[1]


@query("x10_bulk_errors", "WITH ch AS (SELECT p_partkey + CASE WHEN p_partkey % 10 = 0 THEN 10000000 ELSE 0 END AS k FROM part UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 9 = 4) SELECT k AS type_id, 'duplicate' AS error FROM ch GROUP BY k HAVING count(*) > 1 UNION ALL SELECT DISTINCT k, 'unknown' FROM ch WHERE k NOT IN (SELECT p_partkey FROM part)")
def x10_bulk_errors(spark, d):
    types = fx.types(spark, d).select("type_id")
    k = F.col("type_id")
    changes = types.select((k + F.when(k % 10 == 0, 10_000_000).otherwise(0)).alias("type_id")).unionByName(types.where(k % 9 == 4))
    return sv.bulk_errors(changes, types, "type_id", unknown_fails=True)


@query("x10_bulk_rename", "SELECT p_partkey AS type_id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS type_name FROM part")
def x10_bulk_rename(spark, d):
    types = fx.types(spark, d).select("type_id", "type_name")
    changes = types.where("type_id % 3 = 0").select("type_id", F.lit("new").alias("type_name"))
    return sv.bulk_rename(types, changes.unionByName(types.select(F.lit(-1).cast("long").alias("type_id"), F.lit("x").alias("type_name")).distinct()), "type_id", "type_name")


@query("m6_bulk_create", "WITH n AS (SELECT p_brand AS name FROM part WHERE p_size < 3 UNION ALL SELECT p_type FROM part WHERE p_size = 5), g AS (SELECT name, count(*) AS c FROM n GROUP BY name) SELECT name FROM n JOIN g USING (name) WHERE c = 1 AND name NOT IN (SELECT p_brand FROM part WHERE p_size = 1)")
def m6_bulk_create(spark, d):
    part = table(spark, d, "part")
    new = part.where("p_size < 3").select(F.col("p_brand").alias("name")).unionByName(part.where("p_size = 5").select(F.col("p_type").alias("name")))
    return sv.bulk_create(part.where("p_size = 1").select(F.col("p_brand").alias("name")), new, "name")[0]


_STATUS = "st AS (SELECT r_regionkey AS status_id, CASE r_regionkey WHEN 2 THEN 'In Erstellung' ELSE r_name END AS status_name FROM region)"


def _statuses(spark, d):
    key = F.col("r_regionkey")
    return table(spark, d, "region").select(key.alias("status_id"), F.when(key == 2, "In Erstellung").otherwise(F.col("r_name")).alias("status_name"))


@query("m4_new_applicants", "SELECT c_custkey AS project_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS applicant, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS phone FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def m4_new_applicants(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("project_id"), F.when(k % 3 == 0, F.col("c_name")).otherwise("").alias("applicant"), F.when(k % 5 == 0, F.col("c_mktsegment")).alias("phone"))
    return sv.create_projects(rows, _statuses(spark, d), ["applicant", "phone"])[1]


@query("m4_new_projects", "SELECT c_custkey AS project_id, c_name AS name, 2 AS status_id FROM customer")
def m4_new_projects(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("phone"))
    return sv.create_projects(rows, _statuses(spark, d), ["phone"])[0].withColumn("status_id", F.col("status_id").cast("int"))


@query("m5_set_status", f"WITH {_STATUS} SELECT c_custkey AS project_id, coalesce(st.status_id, c_nationkey)::BIGINT AS status_id FROM customer LEFT JOIN st ON st.status_name = CASE c_custkey % 3 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'In Erstellung' ELSE 'none' END")
def m5_set_status(spark, d):
    k = F.col("c_custkey")
    projects = table(spark, d, "customer").select(k.alias("project_id"), F.col("c_nationkey").cast("long").alias("status_id"))
    changes = table(spark, d, "customer").select(k.alias("project_id"), F.when(k % 3 == 0, "ASIA").when(k % 3 == 1, "In Erstellung").otherwise("none").alias("status_name"))
    return sv.set_status(projects, changes, _statuses(spark, d))[0].withColumn("status_id", F.col("status_id").cast("long"))


@query("m7_patch_types", "SELECT p_partkey AS type_id, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 THEN 'renamed' ELSE p_name END AS name, p_partkey % 3 = 0 AS resolved FROM part")
def m7_patch_types(spark, d):
    types = table(spark, d, "part").select(F.col("p_partkey").alias("type_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "custom").otherwise("template").alias("origin"), F.lit(False).alias("resolved"))
    changes = types.where("type_id % 3 = 0").select("type_id", F.lit("renamed").alias("name"), F.lit(True).alias("resolved"))
    return sv.patch_types(types, changes)[0].drop("origin")


@query("m8_resolve_notes", "SELECT o_orderkey AS note_id, o_custkey % 4 = 1 AS resolved FROM orders")
def m8_resolve_notes(spark, d):
    notes = table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), F.lit(False).alias("resolved"))
    ids = table(spark, d, "orders").where("o_custkey % 4 = 1").select(F.col("o_orderkey").alias("note_id"))
    return sv.resolve_notes(notes, ids)[0]


@query("m9_register_projects", "WITH w AS (SELECT o_custkey AS project_id, min_by(o_orderkey % 7, o_orderkey) AS type_id FROM orders GROUP BY o_custkey) SELECT project_id, type_id FROM w WHERE type_id <> 3 AND project_id % 10 <> 1")
def m9_register_projects(spark, d):
    o = table(spark, d, "orders")
    wanted = o.select(F.col("o_custkey").alias("project_id"), (F.col("o_orderkey") % 7).alias("type_id"), F.col("o_orderkey").alias("ord"))
    categories = table(spark, d, "nation").select((F.col("n_nationkey") % 7).alias("type_id"), (F.col("n_nationkey") % 7 == 3).alias("deleted"))
    registered = o.where("o_custkey % 10 = 1").select(F.col("o_custkey").alias("project_id")).distinct()
    return sv.register_projects(registered, wanted, categories)[0].select("project_id", "type_id")


_KEYS = ["project_id", "filename"]
_NEWEST = f"{fx.FILES}, g AS (SELECT project_id, filename, max(version) AS newest, arg_max(deleted, version) AS gone FROM files1 GROUP BY ALL)".replace("files AS (", "files1 AS (SELECT project_id, filename, version, bool_and(deleted) AS deleted FROM (", 1).replace("o_orderkey)", "o_orderkey) GROUP BY ALL)", 1)


def _versions(spark, d):
    return fx.files(spark, d).groupBy("project_id", "filename", "version").agg(F.bool_and("deleted").alias("deleted"))


@query("m11_reserve_versions", f"WITH {_NEWEST} SELECT project_id, filename, CASE WHEN gone THEN newest ELSE newest + 1 END::INT AS version, true AS deleted, gone AS reused FROM g")
def m11_reserve_versions(spark, d):
    files = _versions(spark, d)
    return sv.reserve_versions(files, files, _KEYS)


@query("m10_version_conflicts", f"WITH {_NEWEST} SELECT project_id, filename, 5 AS based_on, (newest + 1)::INT AS next_version, newest <> 5 AS conflict FROM g")
def m10_version_conflicts(spark, d):
    files = _versions(spark, d)
    return sv.version_conflicts(files, files.select(*_KEYS).distinct().withColumn("based_on", F.lit(5)), _KEYS)


@query("m12_start_processing", f"WITH {ARCHIVES}, w AS (SELECT id, project_id FROM archives WHERE id % 5 = 0), go AS (SELECT min(id) AS id FROM w WHERE project_id NOT IN (SELECT project_id FROM archives WHERE workflow_status = 'RUNNING') GROUP BY project_id) SELECT id, CASE WHEN id IN (SELECT id FROM go) THEN 'RUNNING' ELSE workflow_status END AS workflow_status FROM archives")
def m12_start_processing(spark, d):
    archives = _archives(spark, d)
    return sv.start_processing(archives, archives.where("id % 5 = 0"), ["RUNNING"])[0].select("id", "workflow_status")


@query("m10_confirm_uploads", f"WITH {_NEWEST}, u AS (SELECT project_id, filename FROM g WHERE project_id = 3) SELECT f.project_id, f.filename, f.version, f.deleted OR u.filename IS NOT NULL AS deleted FROM files1 f LEFT JOIN u USING (project_id, filename) UNION ALL SELECT project_id, filename, 99, false FROM u")
def m10_confirm_uploads(spark, d):
    files = _versions(spark, d)
    uploads = files.select(*_KEYS).distinct().where("project_id in (3, 4)").withColumn("version", F.lit(99).cast(files.schema["version"].dataType)).withColumn("object_exists", F.col("project_id") == 3)
    return sv.confirm_uploads(files, uploads, _KEYS)[0]


@query("m16_delete_claims", f"WITH {fx.CLAIMS} SELECT claim_id FROM claims WHERE document_id NOT IN (1, 3)")
def m16_delete_claims(spark, d):
    claims = fx.claims(spark, d)
    gone = claims.where("document_id in (1, 3)").select("project_id", "document_id").distinct()
    return sv.delete_claims(claims, gone).select("claim_id")


@query("s6_files_ending", f"WITH {fx.FILES} SELECT id FROM files WHERE NOT deleted AND filename LIKE '%7.pdf' AND project_id = 3")
def s6_files_ending(spark, d):
    return tb.files_ending(fx.files(spark, d), "7.pdf", 3).select("id")


@query("s24_merged_checkpoints", "WITH c AS (SELECT l_orderkey, l_linenumber * 100000000 + l_partkey * 10000 + l_suppkey AS path, unnest([l_partkey, l_suppkey]) AS c, unnest([0, 1]) AS i FROM lineitem) SELECT l_orderkey AS job_id, string_agg(c::VARCHAR, ',' ORDER BY path, i) AS contradictions FROM c GROUP BY l_orderkey")
def s24_merged_checkpoints(spark, d):
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("path"), F.array(F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long")).alias("contradictions"))
    return tb.merged_checkpoints(files).withColumn("contradictions", F.array_join(F.col("contradictions").cast("array<string>"), ","))


@query("s9_zip_guard", """SELECT l_orderkey AS path, count(*) AS n_entries, coalesce(sum(CASE WHEN l_linenumber > 1 THEN l_partkey END), 0)::BIGINT AS total_size, max(CASE WHEN l_linenumber > 1 AND l_suppkey % 3 > 0 THEN l_partkey / (l_suppkey % 3) END) <= 100 IS NOT FALSE AND count(*) <= 6 AS accepted FROM lineitem GROUP BY l_orderkey""")
def s9_zip_guard(spark, d):
    """Entries of archives: first lines are folders, some are packed into no bytes, which sets no ratio."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("path"), (F.col("l_linenumber") == 1).alias("is_dir"), F.lit(0).alias("unix_mode"), F.col("l_partkey").cast("long").alias("file_size"), (F.col("l_suppkey") % 3).cast("long").alias("compress_size")
    )
    return ar.zip_guard(rows, most_entries=6).select("path", "n_entries", "total_size", "accepted")


_PACKED = "SELECT doc_id, 'd/' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.exe' ELSE '.pdf' END AS name, '%PDF-1.7 ' || coalesce(text, '') AS text FROM documents"


def _staged_files(spark, d):
    """The documents as files, every seventh of a kind that is not allowed: written as archives, read back, validated and staged."""
    folder = new_path(spark, "archives")
    name = F.concat(F.lit("./d//"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".exe").otherwise(".pdf"))
    content = F.encode(F.concat(F.lit("%PDF-1.7 "), F.coalesce("text", F.lit(""))), "UTF-8")
    archives = stage(ar.write_archives(table(spark, d, "documents").select(name.alias("name"), content.alias("content")), f"{folder}/in", packed=False), "archive-paths")
    return ar.stage_archives(archives, f"{folder}/out", {".pdf": "application/pdf"}, ["application/pdf"], range_bytes=1 << 20)


@query("s8_stage_archives", f"SELECT name AS filename, doc_id % 7 > 0 AS success, sha256(text) AS sha256, CASE WHEN doc_id % 7 = 0 THEN 'VALIDATION_FAILED' END AS error_code FROM ({_PACKED})")
def s8_stage_archives(spark, d):
    return _staged_files(spark, d).select("filename", "success", "sha256", "error_code")


@query("s14_digests", f"SELECT name AS filename, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM ({_PACKED}) WHERE doc_id % 7 > 0")
def s14_digests(spark, d):
    """Digests of the staged files, read from where they were staged."""
    paths = stage(_staged_files(spark, d).where("success").select(F.col("bucket_path").alias("path")), "staged-paths")
    return ar.file_digests(paths).select(F.regexp_extract("path", r"(d/[^/]*)$", 1).alias("filename"), "sha256", "size")


@query("f11_filtered_points", "SELECT event_id AS id FROM events WHERE user_id % 5 = 1 AND event_type IN ('click', 'view') AND event_id NOT IN (SELECT o_orderkey FROM orders)")
def f11_filtered_points(spark, d):
    points = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("project_id"), F.col("event_type").alias("point_type"))
    return sv.filtered_points(points, 1, kinds=["click", "view"], without=table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))).select("id")


@query("x6_delete_all", f"WITH {fx.TYPES} SELECT count(*) FILTER (NOT deleted) AS n_deleted FROM types")
def x6_delete_all(spark, d):
    return sv.delete_all(fx.types(spark, d))[1]


def _processed(spark, d):
    """Conversations as processed documents: a turn is a chunk on its page and the one after next, with one sub-chunk; every seventh could not be read."""
    none, turn = F.create_map().cast("map<string,string>"), F.col("turn").cast("int")
    sub = F.struct(F.col("chunk_id"), F.col("text").alias("page_content"), none.alias("metadata"), F.array(turn + 1).alias("page_numbers"))
    chunk = F.struct(F.col("chunk_id"), F.col("text").alias("page_content"), none.alias("metadata"), F.array(turn, turn + 2).alias("page_numbers"), F.array(sub).alias("sub_chunks"))
    rows = fx.chunks(spark, d).withColumn("turn", F.col("seq")).groupBy("document_id").agg(F.collect_list(chunk).alias("chunks"))
    return rows.select(F.col("document_id").cast("string").alias("document_name"), F.when(F.col("document_id") % 7 > 0, F.col("chunks")).alias("chunks"))


@query("s4_chunks_up_to_page", f"WITH {fx.CHUNKS} SELECT document_id::VARCHAR AS document_name, chunk_id, NULL::VARCHAR AS error FROM chunks WHERE seq <= 3 AND document_id % 7 > 0 UNION ALL SELECT DISTINCT document_id::VARCHAR, NULL, 'not found' FROM chunks WHERE document_id % 7 = 0")
def s4_chunks_up_to_page(spark, d):
    return tb.chunks_up_to_page(_processed(spark, d), 3).select("document_name", F.col("chunk.chunk_id").alias("chunk_id"), "error")


@query("s5_sub_chunks_up_to_page", f"WITH {fx.CHUNKS} SELECT document_id::VARCHAR AS document_name, chunk_id FROM chunks WHERE seq <= 2 AND document_id % 7 > 0")
def s5_sub_chunks_up_to_page(spark, d):
    return tb.sub_chunks_up_to_page(_processed(spark, d), 3).select("document_name", F.col("sub_chunk.chunk_id").alias("chunk_id"))


def _folder_of_documents(spark, d):
    """The readable ones of those documents, each a file of its own."""
    folder = new_path(spark, "documents")
    dc.write_each(_processed(spark, d).where("chunks is not null"), folder)
    return folder


@query("s2_paged_scan", f"WITH {fx.CHUNKS} SELECT document_id::VARCHAR AS document_name, chunk_id, seq::INT AS first_page FROM chunks WHERE document_id % 7 > 0")
def s2_paged_scan(spark, d):
    """All files of the folder, fifty to a task, chunk by chunk."""
    return dc.read_chunks(spark, _folder_of_documents(spark, d), page_size=50).select("document_name", "chunk_id", "first_page")


@query("s3_pushed_pages", f"WITH {fx.CHUNKS}, k AS (SELECT DISTINCT document_id FROM chunks WHERE document_id BETWEEN 0 AND 20) SELECT document_id::VARCHAR AS document_name, chunk_id, NULL::VARCHAR AS error FROM chunks WHERE seq <= 1 AND document_id % 7 > 0 AND document_id IN (SELECT * FROM k) UNION ALL SELECT document_id::VARCHAR, NULL, 'not found' FROM k WHERE document_id % 7 = 0 UNION ALL SELECT 'none', NULL, 'not found'")
def s3_pushed_pages(spark, d):
    """Named documents up to a page: both filters reach the reader; documents that are not there are rows with an error."""
    known = [r[0] for r in table(spark, d, "conversations").where("conv_id between 0 and 20").select(F.col("conv_id").cast("string")).distinct().collect()]
    chunks = dc.read_chunks(spark, _folder_of_documents(spark, d))
    return chunks.where(F.col("document_name").isin(*known, "none") & (F.col("first_page") <= 1)).select("document_name", "chunk_id", "error")


def _stored_claims(spark, d, condition, version):
    rows = fx.chunks(spark, d).where(condition)
    return rows.select((F.col("document_id") % 3).alias("project_id"), "document_id", F.col("chunk_id").alias("claim_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(version).alias("version"))


@query("s23_upsert_claims", f"""WITH {fx.CHUNKS}, old AS (SELECT document_id, chunk_id, 'old' AS version FROM chunks WHERE document_id % 4 > 0), new AS (SELECT document_id, chunk_id, 'new' AS version FROM chunks WHERE document_id % 5 = 0 AND seq % 2 = 0)
  SELECT document_id % 3 AS project_id, document_id, chunk_id AS claim_id, version, 8 AS dimensions FROM (SELECT * FROM old WHERE document_id NOT IN (SELECT document_id FROM new) UNION ALL SELECT * FROM new)""")
def s23_upsert_claims(spark, d):
    """Claims of some documents are stored, then those of others and of some of the same: the later ones take their documents' place."""
    path = new_path(spark, "claims")
    embed = models.model_column(lambda: models.hashed_embedding(8), T.ArrayType(T.DoubleType()), size=50)
    first = _stored_claims(spark, d, "document_id % 4 > 0", "old").withColumn("vector", embed(F.col("text")))
    bk.write_buckets(first, path, ["project_id", "document_id"], 16)
    bk.upsert_claims(path, _stored_claims(spark, d, "document_id % 5 = 0 and seq % 2 = 0", "new"), embed, 16)
    return bk.read_buckets(spark, path).select("project_id", "document_id", "claim_id", "version", F.size("vector").alias("dimensions"))
