"""File catalog, completeness and job histories over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ca
from ..operators import completeness as co
from ..operators import jobs as jo
from ..operators import markdown as md
from ..sources.tables import replace_partition, table
from ..streaming import jobs as sj
from . import fixtures as fx
from .registry import query


@query("s1_list_files", f"WITH {fx.FILES} SELECT id, filename, version FROM files WHERE type = 'document' AND NOT deleted AND project_id = 3 AND contains(bucket_path, 'p3') AND filename ILIKE '%PART-1%'")
def s1_list_files(spark, d):
    return ca.list_files(fx.files(spark, d), kind="document", project=3, path_part="p3", name_part="PART-1").select("id", "filename", "version")


@query("s1_list_files_page", f"WITH {fx.FILES} SELECT id FROM files WHERE type = 'document' AND NOT deleted ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50")
def s1_list_files_page(spark, d):
    """The second page of the newest documents."""
    return ca.list_files(fx.files(spark, d), kind="document", page=2, page_size=50).select("id")


@query("a3_versions", f"""WITH {fx.FILES} SELECT project_id, filename, type, max(version) + 1 AS next_version, max(struct_pack(v := version, i := id)) FILTER (NOT deleted).v AS latest_version,
  max(struct_pack(v := version, i := id)) FILTER (NOT deleted).i AS latest_id FROM files GROUP BY ALL""".replace("max(struct_pack(v := version, i := id)) FILTER (NOT deleted).v", "(max(struct_pack(v := version, i := id)) FILTER (NOT deleted)).v").replace("max(struct_pack(v := version, i := id)) FILTER (NOT deleted).i", "(max(struct_pack(v := version, i := id)) FILTER (NOT deleted)).i"))
def a3_versions(spark, d):
    return ca.versions(fx.files(spark, d), ["project_id", "filename", "type"])


@query("a4_version_list", f"WITH {fx.FILES} SELECT f.id, f.version FROM files f JOIN files o ON o.id = 11 AND f.project_id = o.project_id AND f.filename = o.filename AND f.type = o.type")
def a4_version_list(spark, d):
    return ca.version_list(fx.files(spark, d), 11).select("id", "version")


@query("f17_expired_files", f"WITH {fx.FILES} SELECT id FROM files WHERE type = 'archive' AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY")
def f17_expired_files(spark, d):
    return ca.expired(fx.files(spark, d), kind="archive", now=F.lit("1998-01-01").cast("timestamp_ntz"), days=365).select("id")


@query("f18_active_workflow", """WITH z AS (SELECT o_custkey % 500 AS project_id, o_orderstatus AS s FROM orders) SELECT project_id, max((s = 'P')::INT) = 1 AS active FROM z GROUP BY project_id""")
def f18_active_workflow(spark, d):
    zips = table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("project_id"), F.col("o_orderstatus").alias("workflow_status"))
    return ca.has_active_workflow(zips, zips.select("project_id").distinct(), ["P"])


@query("x9_publish_newest", f"WITH {fx.FILES} SELECT id, row_number() OVER (PARTITION BY project_id, type, filename ORDER BY version DESC, id DESC) > 1 AS deleted FROM files")
def x9_publish_newest(spark, d):
    return ca.publish_newest(fx.files(spark, d), ["project_id", "type", "filename"]).select("id", "deleted")


@query("a16_priority_file", f"WITH {fx.FILES} SELECT project_id, arg_max(id, struct_pack(s := size, o := -id)) AS id FROM files GROUP BY project_id")
def a16_priority_file(spark, d):
    return ca.priority_file(fx.files(spark, d).withColumn("ord", F.col("id")), "project_id")


_SNAPSHOTS = """cat AS (SELECT 'd/report-' || doc_id || '.txt' AS filename, sha256(text) AS sha256 FROM documents),
  staged AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'd/report-' || doc_id || '-b.txt' ELSE 'd/report-' || doc_id || '.txt' END AS filename, sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS sha256 FROM documents WHERE doc_id % 5 <> 1)"""


def _snapshots(spark, d):
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("d/report-"), F.col("doc_id").cast("string"))
    sha = lambda t: F.sha2(t.cast("binary"), 256)
    old = docs.select(F.concat(name, F.lit(".txt")).alias("filename"), sha(F.col("text")).alias("sha256"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    tail = F.when(F.col("doc_id") % 7 == 0, "-b.txt").otherwise(".txt")
    return docs.where("doc_id % 5 <> 1").select(F.concat(name, tail).alias("filename"), sha(text).alias("sha256")), old


@query("j10_snapshot_diff", f"""WITH {_SNAPSHOTS} SELECT coalesce(s.filename, c.filename) AS filename, CASE WHEN c.filename IS NULL THEN 'new' WHEN s.filename IS NULL THEN 'deleted' WHEN s.sha256 = c.sha256 THEN 'unchanged' ELSE 'changed' END AS change_type,
  s.sha256 AS source_sha, c.sha256 AS target_sha FROM staged s FULL JOIN cat c USING (filename)""")
def j10_snapshot_diff(spark, d):
    return ca.snapshot_diff(*_snapshots(spark, d)).drop("old_name")


@query("j11_renames")
def j11_renames(spark, d):
    return ca.renames(*_snapshots(spark, d))


@query("x1_diff_with_renames")
def x1_diff_with_renames(spark, d):
    new, old = _snapshots(spark, d)
    return ca.snapshot_diff(new, old, ca.renames(new, old))


@query("m13_apply_diff", f"""WITH {_SNAPSHOTS} SELECT coalesce(s.filename, c.filename) AS filename, coalesce(s.sha256, c.sha256) AS sha256, s.filename IS NULL AS deleted FROM staged s FULL JOIN cat c USING (filename)""")
def m13_apply_diff(spark, d):
    new, old = _snapshots(spark, d)
    return ca.apply_diff(old, ca.snapshot_diff(new, old))


@query("x2_edit_errors", """WITH c AS (SELECT doc_id AS k, ['new', 'deleted', 'changed', 'unchanged'][1 + doc_id % 4] AS t FROM documents),
  e AS (SELECT k + CASE WHEN k % 50 = 0 THEN 1000000 ELSE 0 END AS k, CASE WHEN k % 3 = 0 THEN 'unchanged' ELSE t END AS t FROM c UNION ALL SELECT k, t FROM c WHERE k % 40 = 7)
  SELECT k AS file_key, 'duplicate' AS error FROM e GROUP BY k HAVING count(*) > 1 UNION SELECT k, 'unknown' FROM e WHERE k NOT IN (SELECT k FROM c)
  UNION SELECT e.k, 'transition' FROM e JOIN c USING (k) WHERE e.t <> c.t AND c.t || '>' || e.t NOT IN ('new>deleted', 'deleted>unchanged', 'changed>unchanged', 'renamed>unchanged')""")
def x2_edit_errors(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("new", "deleted", "changed", "unchanged")])
    k = F.col("file_key")
    now = table(spark, d, "documents").select(F.col("doc_id").alias("file_key"), F.get(kinds, (F.col("doc_id") % 4).cast("int")).alias("change_type"))
    edited = now.select((k + F.when(k % 50 == 0, 1_000_000).otherwise(0)).alias("file_key"), F.when(k % 3 == 0, "unchanged").otherwise(F.col("change_type")).alias("change_type"))
    return ca.diff_edit_errors(now, edited.unionByName(now.where(k % 40 == 7)))


@query("x3_replace_project", f"WITH {fx.FILES} SELECT id, project_id FROM files WHERE project_id <> 4 UNION ALL SELECT id + 1, 4 FROM files WHERE project_id = 5")
def x3_replace_project(spark, d):
    f = fx.files(spark, d).select("id", "project_id")
    return ca.replace_project(f, f.where("project_id = 5").select((F.col("id") + 1).alias("id"), F.lit(4).cast("long").alias("project_id")), 4)


@query("s22_upsert_documents", f"WITH {fx.FILES}, n AS (SELECT id, filename FROM files WHERE project_id = 5) SELECT id, filename FROM files WHERE filename NOT IN (SELECT filename FROM n) UNION ALL SELECT id, filename FROM n")
def s22_upsert_documents(spark, d):
    f = fx.files(spark, d).select("id", "filename", "project_id")
    return replace_partition(f.select("id", "filename"), f.where("project_id = 5").select("id", "filename"), "filename")


@query("x4_missing_categories", "SELECT DISTINCT p_brand AS name FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey < 20) UNION SELECT 'Benutzerdefiniert'")
def x4_missing_categories(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name"))
    return ca.get_or_create(names.where("p_partkey < 20"), names, "name", "Benutzerdefiniert")


@query("x5_soft_delete", f"WITH {fx.TYPES} SELECT type_id, deleted OR category_id = 7 AS deleted FROM types")
def x5_soft_delete(spark, d):
    return ca.soft_delete(fx.types(spark, d), F.col("category_id") == 7).select("type_id", "deleted")


@query("x7_patch", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'new' ELSE c_name END AS c_name, CASE c_custkey % 3 WHEN 1 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def x7_patch(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    to_map = lambda k, v: F.create_map(F.lit(k), F.lit(v).cast("string"))
    fields = F.when(F.col("c_custkey") % 3 == 0, to_map("c_name", "new")).when(F.col("c_custkey") % 3 == 1, to_map("c_mktsegment", None))
    return ca.patch(c, c.select("c_custkey", fields.alias("fields")).where("fields is not null"), "c_custkey")


_PROJECTS = """p AS (SELECT c_custkey AS project_id, c_name AS name, c_nationkey AS type_id, c_custkey % 7 AS status_id FROM customer)"""


@query("j1_list_projects", f"""WITH {_PROJECTS} SELECT project_id, name, n_name AS type_name, r_name AS status_name, s_name AS applicant_name FROM p JOIN nation ON n_nationkey = type_id JOIN region ON r_regionkey = status_id
  LEFT JOIN supplier ON s_suppkey = project_id WHERE name ILIKE '%1%'""")
def j1_list_projects(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    projects = c.select(k.alias("project_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("type_id"), (k % 7).alias("status_id"))
    types = table(spark, d, "nation").select(F.col("n_nationkey").alias("type_id"), F.col("n_name").alias("type_name"))
    statuses = table(spark, d, "region").select(F.col("r_regionkey").alias("status_id"), F.col("r_name").alias("status_name"))
    applicants = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("applicant_name"))
    return co.list_projects(projects, types, statuses, applicants, "1").select("project_id", "name", "type_name", "status_name", "applicant_name")


@query("j3_template_types", f"WITH {fx.TYPES} SELECT type_id, type_name, n_name AS category_name FROM types JOIN nation ON n_nationkey = category_id WHERE NOT deleted AND n_nationkey % 4 > 0")
def j3_template_types(spark, d):
    cats = table(spark, d, "nation").select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("category_name"), (F.col("n_nationkey") % 4 == 0).alias("deleted"))
    return co.template_types(fx.types(spark, d), cats).select("type_id", "type_name", "category_name")


@query("j5_results", f"""WITH {fx.TYPES}, {fx.ASSIGNED}, g AS (SELECT type_id, count(*) AS n, sum(coalesce(confidence, 0)) AS total, string_agg(document_id || coalesce(reasoning, ''), ',' ORDER BY document_id) AS docs FROM assigned WHERE type_id IS NOT NULL GROUP BY type_id)
  SELECT t.type_id, coalesce(n, 0)::BIGINT AS n, round(coalesce(total, 0), 4) AS total, coalesce(docs, '') AS docs FROM types t LEFT JOIN g USING (type_id) WHERE NOT deleted""")
def j5_results(spark, d):
    r = co.results(fx.types(spark, d), fx.assigned(spark, d))
    total = F.aggregate("documents", F.lit(0.0), lambda s, x: s + x["confidence"])
    docs = F.array_join(F.transform("documents", lambda x: F.concat(x["document_id"].cast("string"), x["reasoning"])), ",")
    return r.select("type_id", F.size("documents").cast("long").alias("n"), F.round(total, 4).alias("total"), docs.alias("docs"))


@query("j5_unassigned", f"WITH {fx.ASSIGNED} SELECT document_id FROM assigned WHERE type_id IS NULL")
def j5_unassigned(spark, d):
    return co.unassigned(fx.assigned(spark, d)).select("document_id")


@query("j6_types_by_category", f"""WITH {fx.TYPES} SELECT n_nationkey AS category_id, coalesce(string_agg(type_name, '|' ORDER BY type_name), '') AS names FROM nation LEFT JOIN types ON category_id = n_nationkey AND NOT deleted GROUP BY n_nationkey""")
def j6_types_by_category(spark, d):
    cats = table(spark, d, "nation").select(F.col("n_nationkey").alias("category_id"))
    return co.types_by_category(cats, fx.types(spark, d)).select("category_id", F.array_join("type_names", "|").alias("names"))


@query("j9_extractions", """WITH e AS (SELECT 'a/doc' || (doc_id % 100) || '/doc' || (doc_id % 100) || '_processed.json' AS path, max(doc_id) AS extraction_id FROM documents WHERE doc_id % 3 > 0 GROUP BY 1)
  SELECT doc_id, extraction_id FROM documents JOIN e ON path = 'a/doc' || doc_id || '/doc' || doc_id || '_processed.json'""")
def j9_extractions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("a/doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))
    k = (F.col("doc_id") % 100).cast("string")
    path = F.concat(F.lit("a/doc"), k, F.lit("/doc"), k, F.lit("_processed.json"))
    ext = docs.where("doc_id % 3 > 0").select(path.alias("path"), F.col("doc_id").alias("extraction_id"), F.col("doc_id").alias("ord"))
    return co.document_extractions(docs, ext).select("doc_id", "extraction_id")


@query("a5_type_confidence")
def a5_type_confidence(spark, d):
    return co.type_confidence(fx.assigned(spark, d).where("type_id is not null").withColumn("confidence", 1 - F.col("confidence")).withColumn("ord", F.col("document_id")))


@query("a8_counters", f"""WITH {fx.TYPES}, {fx.ASSIGNED} SELECT (SELECT count(*) FROM types WHERE NOT deleted AND type_id IN (SELECT type_id FROM assigned WHERE type_id IS NOT NULL)) AS matched,
  (SELECT count(*) FROM types WHERE deleted) AS deleted, (SELECT count(type_id) FROM assigned) AS assigned, (SELECT count(*) FROM assigned WHERE type_id IS NULL) AS unassigned""")
def a8_counters(spark, d):
    return co.counters(fx.types(spark, d), fx.assigned(spark, d))


@query("a9_contents_status", f"""WITH {fx.TYPES}, {fx.ASSIGNED}, g AS (SELECT category_id, count(*) FILTER (NOT deleted) AS n_types, count(*) FILTER (NOT deleted AND type_id NOT IN (SELECT type_id FROM assigned WHERE type_id IS NOT NULL)) AS n_missing FROM types GROUP BY category_id)
  SELECT *, CASE WHEN n_types = 0 THEN 'none' WHEN n_missing = 0 THEN 'complete' ELSE 'missing' END AS status FROM g""")
def a9_contents_status(spark, d):
    return co.contents_status(fx.types(spark, d), fx.assigned(spark, d))


@query("t3_refine", """WITH m AS (SELECT l_orderkey AS document_id, CASE WHEN l_linenumber > 1 THEN l_partkey END AS type_id, l_discount AS confidence FROM lineitem)
  SELECT document_id, CASE count(type_id) WHEN 0 THEN 'unassigned' WHEN 1 THEN 'matched' ELSE 'refine' END AS state,
    coalesce(string_agg(type_id::VARCHAR, ',' ORDER BY confidence DESC, type_id) FILTER (type_id IS NOT NULL), '') AS shortlist FROM m GROUP BY document_id""")
def t3_refine(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_linenumber") > 1, F.col("l_partkey")).alias("type_id"), F.col("l_discount").alias("confidence"))
    return co.refine(m).withColumn("shortlist", F.array_join(F.col("shortlist").cast("array<string>"), ","))


@query("f22_guarded_index", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 2 >= 0 AND l_linenumber - 2 < l_partkey % 5 THEN l_linenumber - 2 ELSE -1 END AS index FROM lineitem")
def f22_guarded_index(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", co.guarded_index(F.col("l_linenumber") - 2, F.col("l_partkey") % 5).alias("index"))


@query("f23_failure_gate", "SELECT avg((event_type = 'error')::INT) AS rate, avg((event_type = 'error')::INT) <= 0.3 AS passed FROM events")
def f23_failure_gate(spark, d):
    return co.failure_gate(table(spark, d, "events").select(F.when(F.col("event_type") == "error", "x").alias("error")))


@query("c52_flatten_requirements", """SELECT p_brand AS category, p_name AS name, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END AS description, p_size % 2 = 0 AND p_size % 5 > 0 AS optional FROM part""")
def c52_flatten_requirements(spark, d):
    size = F.col("p_size")
    child = F.struct(
        F.col("p_name").alias("name"),
        F.when(size % 5 > 0, size % 2 > 0).alias("required"),
        F.when(size % 3 == 0, F.concat(F.lit(" "), "p_type")).otherwise(F.lit("  ")).alias("contentRequirements"),
    )
    return co.flatten_requirements(table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.collect_list(child).alias("children")))


@query("f20_valid_intervals", "SELECT o_orderkey, coalesce(o_orderdate <= l.d, true) AS valid FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS d FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) l ON l_orderkey = o_orderkey")
def f20_valid_intervals(spark, d):
    ends = table(spark, d, "lineitem").where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("d"))
    return table(spark, d, "orders").join(ends, "o_orderkey", "left").select("o_orderkey", co.valid_interval(F.col("o_orderdate"), F.col("d")).alias("valid"))


_FOLD = f"""{fx.EVENTS}, k AS (SELECT *, CASE event_type WHEN 'scheduled' THEN 'pending' WHEN 'started' THEN 'running' WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'failed' END AS status FROM ev),
  fold AS (SELECT workflow_id, ref, arg_max(status, event_id) AS status, arg_max(message, event_id) AS message, count(*) AS n_events FROM k WHERE status IS NOT NULL GROUP BY ALL)"""


@query("r1_fold_status", f"WITH {_FOLD} SELECT * FROM fold")
def r1_fold_status(spark, d):
    return jo.fold_status(fx.job_events(table(spark, d, "events")))


@query("r1_child_overrides", f"WITH {_FOLD}, own AS (SELECT workflow_id AS ref, status AS s FROM fold WHERE ref = '0') SELECT f.workflow_id, f.ref, coalesce(s, f.status) AS status FROM fold f LEFT JOIN own o ON f.ref = o.ref")
def r1_child_overrides(spark, d):
    view = jo.fold_status(fx.job_events(table(spark, d, "events")))
    return jo.child_overrides(view, view.where("ref = '0'")).select("workflow_id", "ref", "status")


@query("a6_latest_by_status", "SELECT event_type AS status, arg_max(event_id, struct_pack(t := ts, i := -event_id)) AS id, max(ts) AS at FROM events GROUP BY event_type")
def a6_latest_by_status(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("close_time"), F.col("ts").alias("start_time"))
    return jo.latest_by_status(e)


@query("r4_approvals", """WITH j AS (SELECT user_id AS workflow_id, min(ts) AS started FROM events GROUP BY user_id), s AS (SELECT user_id AS workflow_id, ts, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' END AS signal FROM events WHERE event_type IN ('purchase', 'error')),
  f AS (SELECT workflow_id, arg_min(signal, struct_pack(t := ts, s := signal)) AS signal FROM s JOIN j USING (workflow_id) WHERE ts <= started + INTERVAL 7 DAY GROUP BY workflow_id)
  SELECT workflow_id, CASE WHEN signal = 'approve' THEN 'APPROVED' WHEN signal = 'reject' THEN 'REJECTED' WHEN started + INTERVAL 7 DAY < TIMESTAMP '2024-01-20' THEN 'REJECTED' ELSE 'PENDING' END AS state FROM j LEFT JOIN f USING (workflow_id)""")
def r4_approvals(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "workflow_id")
    signal = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject")
    signals = e.select("workflow_id", "ts", signal.alias("signal")).where("signal is not null")
    return jo.approvals(e.groupBy("workflow_id").agg(F.min("ts").alias("started")), signals, F.lit("2024-01-20").cast("timestamp_ntz"))


@query("f25_allowed_visual_failures", "SELECT p_partkey, greatest(1, floor(p_size * 0.2))::INT AS allowed FROM part")
def f25_allowed_visual_failures(spark, d):
    return table(spark, d, "part").select("p_partkey", jo.allowed_visual_failures(F.col("p_size").cast("double")).alias("allowed"))


@query("s29_part_actions", """WITH p AS (SELECT o_custkey AS document_id, o_orderkey AS page_offset, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 4 > 0 THEN 'keep' WHEN o_orderkey % 5 = 0 OR o_totalprice > 100000 OR o_custkey % 4 = 0 THEN 'drop' ELSE 'rasterize' END AS action FROM orders)
  SELECT document_id, page_offset, (row_number() OVER (PARTITION BY document_id ORDER BY page_offset) - 1)::INT AS pos, action, CASE WHEN count(*) FILTER (action <> 'drop') OVER (PARTITION BY document_id) = 0 THEN 'no part could be read' END AS error FROM p""")
def s29_part_actions(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 4
    parts = table(spark, d, "orders").select(
        F.col("o_custkey").alias("document_id"), k.alias("page_offset"), ((k % 3 == 0) & (c > 0)).alias("ok"), ((k % 5 == 0) | (c == 0)).alias("timed_out"), (F.col("o_totalprice") / 4000).alias("size_mb")
    )
    return jo.part_actions(parts).select("document_id", "page_offset", "pos", "action", "error")


@query("s29_assembled_parts", """WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS page_offset, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 4 > 0 THEN 'a' || o_orderkey WHEN o_orderkey % 5 = 0 OR o_totalprice > 100000 OR o_custkey % 4 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'b' || o_orderkey END AS said FROM orders),
  m AS (SELECT *, count(said) OVER (PARTITION BY doc_id) AS n FROM p)
  SELECT doc_id, count(said) AS n_parts, string_agg('<seite nummer="' || (CASE WHEN n > 1 THEN 1 + page_offset ELSE 1 END) || '" />' || said, '' ORDER BY page_offset) FILTER (said IS NOT NULL) AS markdown, CASE WHEN count(said) = 0 THEN 'no part could be read' END AS error FROM m GROUP BY doc_id""")
def s29_assembled_parts(spark, d):
    """Kept parts and those that a second reading brought, which fails for odd ones, joined in the order of their pages."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 4
    said = lambda x: F.concat(F.lit('<seite nummer="1" />' + x), k.cast("string"))
    orders = table(spark, d, "orders")
    parts = orders.select(
        F.col("o_custkey").alias("document_id"), k.alias("part"), k.alias("page_offset"), ((k % 3 == 0) & (c > 0)).alias("ok"), ((k % 5 == 0) | (c == 0)).alias("timed_out"), (F.col("o_totalprice") / 4000).alias("size_mb"), said("a").alias("markdown")
    )
    again = orders.select(F.col("o_custkey").alias("document_id"), k.alias("part"), F.when(k % 2 == 0, said("b")).alias("markdown"))
    return md.assembled_parts(jo.part_actions(parts), again).select("doc_id", "n_parts", "markdown", "error")


@query("r5_backoff", "SELECT l_orderkey, l_linenumber, least(30 * 2 ** (l_linenumber - 1), 300)::INT AS seconds FROM lineitem")
def r5_backoff(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", jo.backoff_seconds(F.col("l_linenumber")).alias("seconds"))


@query("f21_source_reference", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size % 4 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'file' WHEN p_size % 3 = 1 THEN 'manual' END AS kind FROM part")
def f21_source_reference(spark, d):
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "file").when(size % 3 == 1, "manual")
    return table(spark, d, "part").select("p_partkey", co.source_reference(kind, F.when(size % 4 > 0, F.col("p_name")))["type"].alias("kind"))


@query("c54_contents_to_types", "SELECT p_type || ' > ' || p_brand AS category, p_name AS document_type, CASE WHEN p_size % 2 = 0 THEN p_size || ': ' ELSE '' END || p_name AS description FROM part")
def c54_contents_to_types(spark, d):
    number = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("")
    entries = table(spark, d, "part").select(F.array("p_type", "p_brand").alias("path"), F.col("p_name").alias("title"), number.alias("number"))
    return co.contents_to_types(entries)


@query("f24_allowed_failures", "SELECT p_partkey, greatest(round_even(p_size * 0.15, 0), 2)::INT AS allowed FROM part")
def f24_allowed_failures(spark, d):
    return table(spark, d, "part").select("p_partkey", jo.allowed_failures(F.col("p_size").cast("double")).alias("allowed"))


@query("s16_split_plan", """WITH f AS (SELECT p_partkey AS file_id, p_size AS pages, p_retailprice / 20 AS mb FROM part WHERE p_size > 0),
  n AS (SELECT *, CASE WHEN mb < 40 THEN pages ELSE least(50, greatest(1, floor(25 / (mb / pages))::INT)) END AS n FROM f), s AS (SELECT *, unnest(range(1, pages + 1, n)) AS first_page FROM n)
  SELECT file_id, ((first_page - 1) // n)::INT AS part, first_page::INT AS first_page, least(first_page + n - 1, pages)::INT AS last_page FROM s""")
def s16_split_plan(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_size").alias("pages"), (F.col("p_retailprice") / 20).alias("size_mb"))
    return jo.split_plan(f)


@query("s27_log_records", """SELECT event_id, '{' || array_to_string(list_filter(['"event_type":' || to_json(event_type)::VARCHAR, '"user_id":' || to_json(user_id)::VARCHAR, '"props":' || to_json(props)::VARCHAR], lambda x: x IS NOT NULL), ',') || '}' AS record FROM events""")
def s27_log_records(spark, d):
    return table(spark, d, "events").select("event_id", jo.log_record(["event_type", "user_id", "props"]).alias("record"))


def _events_stream(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("r4_approvals_stream", """WITH j AS (SELECT user_id AS workflow_id, min(ts) AS started FROM events GROUP BY user_id), s AS (SELECT user_id AS workflow_id, ts, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' END AS signal FROM events WHERE event_type IN ('purchase', 'error')),
  f AS (SELECT workflow_id, arg_min(signal, struct_pack(t := ts, s := signal)) AS signal FROM s JOIN j USING (workflow_id) WHERE ts <= started + INTERVAL 1 DAY GROUP BY workflow_id)
  SELECT workflow_id, CASE WHEN signal = 'approve' THEN 'APPROVED' WHEN signal = 'reject' THEN 'REJECTED' WHEN started + INTERVAL 1 DAY < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR THEN 'REJECTED' ELSE 'PENDING' END AS state FROM j LEFT JOIN f USING (workflow_id)""")
def r4_approvals_stream(spark, d):
    """The events as a stream, timed out by the watermark; at its end the batch result as of that time."""
    signal = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject")
    events = _events_stream(spark, d).select(F.col("user_id").alias("workflow_id"), "ts", signal.alias("signal"))
    return sj.latest(sj.approvals_stream(events, days=1), ["workflow_id"])


@query("r2_overrides_stream", f"WITH {_FOLD}, own AS (SELECT workflow_id AS ref, status AS s FROM fold WHERE ref = '0') SELECT f.workflow_id, f.ref, coalesce(s, f.status) AS status FROM fold f LEFT JOIN own o ON f.ref = o.ref")
def r2_overrides_stream(spark, d):
    return sj.latest(sj.child_overrides_stream(fx.job_events(_events_stream(spark, d)), "0"), ["workflow_id", "ref"])
