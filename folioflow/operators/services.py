"""Reads and changes of the services around the documents: every read is a query, every change the next state of a table.

Changes that a rule may refuse return the refused rows as well, so that a caller can report them; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The status of a new project, the fields that make an applicant.
NEW_STATUS = "In Erstellung"


# Reads


def page_of(rows: DataFrame, *order: Column, offset: int = 0, limit: int | None = None) -> DataFrame:
    """``rows`` in ``order``, from ``offset`` on, at most ``limit`` of them."""
    out = rows.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def list_comments(comments: DataFrame, project, *, steps: list | None = None, sources: list | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Comments of a project, oldest first; of some process steps and kinds of source only, if given."""
    out = comments.where(F.col("project_id") == project)
    if steps is not None:
        out = out.where(F.col("process_step").isin(steps))
    if sources is not None:
        out = out.where(F.col("source_type").isin(sources))
    return page_of(out, F.asc("created_at"), F.asc("id"), offset=offset, limit=limit)


def list_deadlines(deadlines: DataFrame, project=None) -> DataFrame:
    out = deadlines if project is None else deadlines.where(F.col("project_id") == project)
    return out.orderBy(F.asc("end_at"), F.asc("id"))


def list_steps(steps: DataFrame, project_type=None) -> DataFrame:
    return steps if project_type is None else steps.where(F.col("type_id") == project_type)


def list_archives(archives: DataFrame, *, project=None, status=None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """ZIP archives, newest first."""
    out = archives
    for name, value in (("project_id", project), ("status", status)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return page_of(out, F.desc("created_at"), F.desc("id"), offset=offset, limit=limit)


def by_id(rows: DataFrame, key: str, value, *, include_deleted: bool = True) -> DataFrame:
    """The row of a key; a deleted one only if asked for."""
    out = rows.where(F.col(key) == value)
    return out if include_deleted or "deleted" not in rows.columns else out.where(~F.col("deleted"))


def by_ids(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """key, n, error and the row of each wanted key: an error where there is not exactly one."""
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.any_value(F.struct(*rows.columns)).alias("row"))
    out = wanted.select(key).distinct().join(found, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("error", F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous")).withColumn("row", F.when(F.col("n") == 1, F.col("row")))


def step_id(steps: DataFrame, types: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (type_name, step_index) with step_id, null where there is no such step."""
    named = steps.join(types.select("type_id", "type_name"), "type_id").select("type_name", "step_index", "step_id")
    return wanted.join(named, ["type_name", "step_index"], "left")


def notes_with_places(notes: DataFrame, places: DataFrame, project=None) -> DataFrame:
    """Notes with an ``occurrences`` array (empty without any), in the order of their creation."""
    held = places.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in places.columns if c != "note_id"]))).alias("occurrences"))
    rows = notes if project is None else notes.where(F.col("project_id") == project)
    out = rows.join(held, "note_id", "left")
    empty = F.array().cast(held.schema["occurrences"].dataType)
    return out.withColumn("occurrences", F.coalesce("occurrences", empty)).orderBy("created_at", "note_id")


def newest_notes(notes: DataFrame, project) -> DataFrame:
    return notes.where(F.col("project_id") == project).orderBy(F.desc("created_at"), F.desc("note_id"))


def file_assignments(documents: DataFrame) -> DataFrame:
    """document_id, file_id, type_id of documents that have a file."""
    return documents.where(F.col("file_id").isNotNull()).select("document_id", "file_id", "type_id")


def priority_documents(classified: DataFrame, name: str) -> DataFrame:
    """classification, document_id: the documents of the first entry of a name.  ``classified``: classification, entries array<struct<name, document_ids>>."""
    first = F.get(F.filter("entries", lambda e: e["name"] == name), F.lit(0))
    return classified.select("classification", F.explode(first["document_ids"]).alias("document_id"))


def windows(text: Column, size: int) -> Column:
    """``text`` in pieces of ``size`` characters, none for a blank one."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, (i - 1) * size + 1, F.lit(size)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def evidence(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with any field that is not null."""
    return rows.where(F.coalesce(*fields).isNotNull())


def processing_totals(rows: DataFrame, key: str) -> DataFrame:
    """Per key: total, succeeded and failed rows (``error`` is null or not)."""
    return rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def grouped_documents(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Adds representative: the first document_id of those with equal ``keys``, and whether the row is it."""
    first = F.min("document_id").over(Window.partitionBy(*keys))
    return documents.withColumn("representative", first).withColumn("is_representative", F.col("document_id") == first)


def representative_matches(documents: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Every document with what its group's representative was matched to.  ``matches``: document_id, type_id of representatives."""
    grouped = grouped_documents(documents, keys)
    return grouped.join(matches.select(F.col("document_id").alias("representative"), "type_id"), "representative", "left").select("document_id", "type_id")


def filtered_points(points: DataFrame, project, *, kinds: list[str] | None = None, without: DataFrame | None = None) -> DataFrame:
    """Points of a project, of some kinds if given, but for the ids in ``without`` (id)."""
    out = points.where(F.col("project_id") == project)
    if kinds is not None:
        out = out.where(F.col("point_type").isin(kinds))
    return out if without is None else out.join(without.select("id"), "id", "left_anti")


# Changes


def delete_all(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows deleted, and one row with how many were not yet."""
    return rows.withColumn("deleted", F.lit(True)), rows.agg(F.count_if(~F.col("deleted")).alias("n_deleted"))


def delete_project(types: DataFrame, documents: DataFrame, project) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Types and documents without a project's, and one row with how many of each went: documents without a type, and types."""
    mine = F.col("project_id") == project
    counts = types.where(mine).agg(F.count("*").alias("deleted_types")).join(documents.where(mine & F.col("type_id").isNull()).agg(F.count("*").alias("deleted_documents")))
    return types.where(~mine), documents.where(~mine), counts


def override_assignments(documents: DataFrame, changes: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents after a human's choice of type, and the changes that name no type.  ``changes``: file_id, type_id (null takes the type away)."""
    known = types.select("type_id").distinct().withColumn("__known", F.lit(True))
    told = changes.join(known, "type_id", "left")
    ok = told.where(F.col("type_id").isNull() | F.col("__known"))
    new = ok.select("file_id", F.col("type_id").alias("__type"), F.lit(True).alias("__changed"))
    out = documents.join(new, "file_id", "left").withColumn("type_id", F.when(F.col("__changed"), F.col("__type")).otherwise(F.col("type_id")))
    refused = told.where(F.col("type_id").isNotNull() & F.col("__known").isNull()).select("file_id", "type_id", F.lit("unknown type").alias("error"))
    return out.select(*documents.columns), refused


def bulk_errors(changes: DataFrame, current: DataFrame, key: str, *, unknown_fails: bool) -> DataFrame:
    """key, error of a bulk change: keys given twice, and unknown ones where those fail (deletes) rather than being ignored (updates)."""
    twice = changes.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("error"))
    if not unknown_fails:
        return twice
    return twice.unionByName(changes.select(key).distinct().join(current.select(key), key, "left_anti").withColumn("error", F.lit("unknown")))


def bulk_rename(current: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``current`` with the new ``column`` of keys that ``changes`` names; unknown keys are ignored."""
    new = changes.select(key, F.col(column).alias("__new"))
    return current.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).select(*current.columns)


def bulk_create(current: DataFrame, new: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows to add, and names that are taken or given twice."""
    twice = new.groupBy(name).count().where("count > 1").select(name, F.lit("duplicate").alias("error"))
    taken = new.select(name).distinct().join(current.select(name), name, "left_semi").withColumn("error", F.lit("taken"))
    refused = twice.unionByName(taken)
    return new.join(refused.select(name), name, "left_anti"), refused


def create_projects(projects: DataFrame, statuses: DataFrame, applicant_fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New projects with the first status, their applicants (rows with any filled field), and projects refused as that status is missing."""
    status = statuses.where(F.col("status_name") == NEW_STATUS).agg(F.min("status_id").alias("status_id"))
    rows = projects.drop("status_id").join(F.broadcast(status))
    ok = rows.where("status_id is not null")
    filled = F.exists(F.array(*[F.col(c).cast("string") for c in applicant_fields]), lambda x: x.isNotNull() & (x != ""))
    applicants = ok.where(filled).select("project_id", *applicant_fields)
    refused = rows.where("status_id is null").select("project_id", F.lit("no status").alias("error"))
    return ok.drop(*applicant_fields), applicants, refused


def set_status(projects: DataFrame, changes: DataFrame, statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects with a new status by name, and changes that name none.  ``changes``: project_id, status_name."""
    told = changes.join(statuses.select("status_name", F.col("status_id").alias("__status")), "status_name", "left")
    out = projects.join(told.where("__status is not null").select("project_id", "__status"), "project_id", "left")
    out = out.withColumn("status_id", F.coalesce("__status", "status_id")).select(*projects.columns)
    return out, told.where("__status is null").select("project_id", "status_name", F.lit("unknown status").alias("error"))


def patch_types(types: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types after changes (type_id, name, resolved; null keeps), and renames of types that are not custom, which are refused."""
    told = types.join(changes.select("type_id", F.col("name").alias("__name"), F.col("resolved").alias("__resolved")), "type_id", "left")
    custom = F.col("origin") == "custom"
    out = told.withColumn("name", F.when(custom, F.coalesce("__name", "name")).otherwise(F.col("name"))).withColumn("resolved", F.coalesce("__resolved", "resolved"))
    refused = told.where(F.col("__name").isNotNull() & ~custom).select("type_id", F.lit("not custom").alias("error"))
    return out.select(*types.columns), refused


def resolve_notes(notes: DataFrame, ids: DataFrame, resolved: bool = True) -> tuple[DataFrame, DataFrame]:
    """Notes with their state set, and ids that there are none of.  ``ids``: note_id."""
    hit = ids.select("note_id").distinct().withColumn("__hit", F.lit(True))
    out = notes.join(hit, "note_id", "left").withColumn("resolved", F.when(F.col("__hit"), F.lit(resolved)).otherwise(F.col("resolved")))
    return out.select(*notes.columns), hit.join(notes.select("note_id"), "note_id", "left_anti").select("note_id", F.lit("not found").alias("error"))


def create_templates(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Categories (category_name, ord) and types (category_name, type_name, ord) of nested templates: name, types array<string>."""
    categories = nested.select(F.col("name").alias("category_name"), "ord")
    return categories, nested.select(F.col("name").alias("category_name"), F.posexplode("types").alias("ord", "type_name"))


def register_projects(registered: DataFrame, wanted: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New registrations of projects whose type has a live template category, the first writer wins; and projects refused for lack of one.

    ``wanted``: project_id, type_id, ord; ``categories``: type_id, deleted.
    """
    live = categories.where(~F.col("deleted")).select("type_id").distinct()
    once = wanted.withColumn("__rn", F.row_number().over(Window.partitionBy("project_id").orderBy("ord"))).where("__rn = 1").drop("__rn")
    new = once.join(live, "type_id", "left_semi").join(registered.select("project_id"), "project_id", "left_anti")
    return new, once.join(live, "type_id", "left_anti").select("project_id", F.lit("no template").alias("error"))


def reserve_versions(files: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Deleted rows that reserve the next version of each wanted file; a reservation that is already the newest row is taken up again.

    ``files``: keys, version, deleted; the result: keys, version, deleted, reused.
    """
    newest = files.groupBy(*keys).agg(F.max_by(F.struct("version", "deleted"), "version").alias("__n"))
    out = wanted.select(*keys).distinct().join(newest, keys, "left")
    reused = F.coalesce(F.col("__n.deleted"), F.lit(False))
    version = F.when(reused, F.col("__n.version")).otherwise(F.coalesce(F.col("__n.version"), F.lit(0)) + 1)
    return out.select(*keys, version.cast("int").alias("version"), F.lit(True).alias("deleted"), reused.alias("reused"))


def version_conflicts(files: DataFrame, uploads: DataFrame, keys: list[str]) -> DataFrame:
    """Uploads with ``next_version`` and ``conflict``: another version is the newest than the one the upload was made for.

    ``uploads``: keys, based_on (null for a new file).
    """
    newest = files.groupBy(*keys).agg(F.max("version").alias("__newest"))
    out = uploads.join(newest, keys, "left")
    clash = ~F.col("__newest").eqNullSafe(F.col("based_on"))
    return out.withColumn("next_version", (F.coalesce("__newest", F.lit(0)) + 1).cast("int")).withColumn("conflict", clash).drop("__newest")


def start_processing(archives: DataFrame, wanted: DataFrame, blocking: list[str]) -> tuple[DataFrame, DataFrame]:
    """Archives with the wanted ones running, and those refused as their project has a blocking one.  ``wanted``: id.

    Of several wanted archives of a project the first starts.
    """
    busy = archives.where(F.col("workflow_status").isin(blocking)).select("project_id").distinct()
    asked = archives.join(wanted.select("id").distinct(), "id", "left_semi")
    first = asked.withColumn("__rn", F.row_number().over(Window.partitionBy("project_id").orderBy("id"))).where("__rn = 1")
    go = first.join(busy, "project_id", "left_anti").select("id", F.lit(True).alias("__go"))
    out = archives.join(go, "id", "left").withColumn("workflow_status", F.when(F.col("__go"), "RUNNING").otherwise(F.col("workflow_status")))
    refused = asked.join(go, "id", "left_anti").select("id", F.lit("project is busy").alias("error"))
    return out.select(*archives.columns), refused


def set_archive_status(archives: DataFrame, changes: DataFrame) -> DataFrame:
    """Archives with the status of ``changes`` (id, status); what failed to start goes back to what it was this way."""
    new = changes.select("id", F.col("status").alias("__status"))
    return archives.join(new, "id", "left").withColumn("workflow_status", F.coalesce("__status", "workflow_status")).select(*archives.columns)


def confirm_uploads(files: DataFrame, uploads: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files after uploads were confirmed: earlier live versions deleted, the upload added; and uploads whose object is missing.

    ``uploads``: keys, version, object_exists.
    """
    ok = uploads.where("object_exists").select(*keys, "version")
    hit = ok.select(*keys).distinct().withColumn("__hit", F.lit(True))
    old = files.join(hit, keys, "left").withColumn("deleted", F.col("deleted") | F.coalesce("__hit", F.lit(False))).select(*files.columns)
    out = old.unionByName(ok.withColumn("deleted", F.lit(False)), allowMissingColumns=True)
    return out, uploads.where("not object_exists").select(*keys, F.lit("not uploaded").alias("error"))


def delete_claims(claims: DataFrame, gone: DataFrame) -> DataFrame:
    """Claims without those of the documents in ``gone`` (project_id, document_id; a null document stands for the whole project)."""
    whole = gone.where("document_id is null").select("project_id").distinct()
    return claims.join(whole, "project_id", "left_anti").join(gone.where("document_id is not null").select("project_id", "document_id"), ["project_id", "document_id"], "left_anti")
