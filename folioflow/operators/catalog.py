"""The versioned file catalog: listings, versions, snapshots' differences, retention, changes as pure functions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def list_files(files: DataFrame, *, kind: str, project=None, path_part=None, name_part=None, page=None, page_size=None, include_deleted=False) -> DataFrame:
    """Files of a type, newest first; a page of them if ``page_size`` is given."""
    out = files.where(F.col("type") == kind)
    if not include_deleted:
        out = out.where(~F.col("deleted"))
    if project is not None:
        out = out.where(F.col("project_id") == project)
    if path_part is not None:
        out = out.where(F.col("bucket_path").contains(path_part))
    if name_part is not None:
        out = out.where(F.col("filename").ilike(f"%{name_part}%"))
    out = out.orderBy(F.desc("created_at"), F.desc("id"))
    return out if page_size is None else out.offset(((page or 1) - 1) * page_size).limit(page_size)


def versions(files: DataFrame, keys: list[str]) -> DataFrame:
    """Per file identity: next_version over all rows, and the newest row that is not deleted."""
    live = F.when(~F.col("deleted"), F.struct("version", "id"))
    return files.groupBy(*keys).agg((F.max("version") + 1).cast("int").alias("next_version"), F.max(live).alias("latest")).select(
        *keys, "next_version", F.col("latest.version").alias("latest_version"), F.col("latest.id").alias("latest_id")
    )


def version_list(files: DataFrame, file_id) -> DataFrame:
    """All versions of the file that ``file_id`` is one of, newest first."""
    one = files.where(F.col("id") == file_id).select(*[F.col(c).alias(f"_{c}") for c in ("project_id", "filename", "type")])
    same = F.col("project_id").eqNullSafe(F.col("_project_id")) & (F.col("filename") == F.col("_filename")) & (F.col("type") == F.col("_type"))
    return files.join(F.broadcast(one.limit(1)), same, "left_semi").orderBy(F.desc("version"))


def expired(files: DataFrame, *, kind: str, now: Column, days: int) -> DataFrame:
    """What a retention of ``days`` removes; the complement is the next state."""
    return files.where((F.col("type") == kind) & (F.col("created_at") < now - F.make_interval(days=F.lit(days))))


def has_active_workflow(zips: DataFrame, projects: DataFrame, blocking: list[str]) -> DataFrame:
    busy = zips.where(F.col("workflow_status").isin(blocking)).select("project_id").distinct()
    return projects.join(busy.withColumn("active", F.lit(True)), "project_id", "left").withColumn("active", F.coalesce("active", F.lit(False)))


def _first_by_name(rows: DataFrame, side: str) -> DataFrame:
    order = F.struct(*[c for c in ("bucket_path", "sha256") if c in rows.columns])
    return rows.groupBy("filename").agg(F.min_by("sha256", order).alias(f"{side}_sha"))


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of lower-case names."""
    return pd.Series([SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)])


def _letters(name: Column) -> Column:
    """The letters of a lower-case name, each with the number of its occurrence: what two names share is their common letters."""
    letters = F.split(F.lower(name), "")
    return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def renames(staged: DataFrame, catalog: DataFrame, *, least: float = 0.65, same_folder: bool = True, block: int = 1000) -> DataFrame:
    """old_name, filename, sha of pairs with one content and similar names; each unordered pair once.

    Files meet by content and folder; of a content that many files have (empty ones) the old names are dealt into blocks
    of about ``block``, each joined by itself.  Lengths and common letters bound the ratio from above, in Spark; only names
    that these let through are compared by Python, one by one.  The comparison is not symmetric: the staged name comes
    first.  Of two files that swap their names the one whose staged name sorts first stays.
    """
    old = catalog.select(F.col("filename").alias("old_name"), F.col("sha256").alias("sha")).distinct()
    new = staged.select("filename", F.col("sha256").alias("sha")).distinct()
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "") if same_folder else F.lit("")
    old = old.withColumn("folder", folder(F.col("old_name"))).withColumn("__old", _letters(F.col("old_name")))
    new = new.withColumn("folder", folder(F.col("filename"))).withColumn("__new", _letters(F.col("filename")))
    keys = ["sha", "folder"]
    blocks = old.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    old = old.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("old_name"), F.col("blocks")).cast("int")).drop("blocks")
    new = new.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    pairs = new.join(old, [*keys, "block"]).where(F.col("old_name") != F.col("filename"))
    both = F.size("__new") + F.size("__old")
    pairs = pairs.where(2.0 * F.least(F.size("__new"), F.size("__old")) >= (least - 1e-9) * both)
    pairs = pairs.where(2.0 * F.size(F.array_intersect("__new", "__old")) >= (least - 1e-9) * both).select("old_name", "filename", "sha")
    pairs = pairs.where(name_similarity("filename", "old_name") >= least)
    once = Window.partitionBy(F.least("old_name", "filename"), F.greatest("old_name", "filename")).orderBy("filename", "sha")
    return pairs.withColumn("rn", F.row_number().over(once)).where("rn = 1").select("old_name", "filename", "sha")


def snapshot_diff(staged: DataFrame, catalog: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """filename, change_type (new, deleted, changed, unchanged, renamed), source_sha, target_sha, old_name.

    Names on either side of a rename take no part in the other kinds.
    """
    both = _first_by_name(staged, "source").join(_first_by_name(catalog, "target"), "filename", "full_outer")
    kind = (
        F.when(F.col("target_sha").isNull(), "new")
        .when(F.col("source_sha").isNull(), "deleted")
        .when(F.col("source_sha") == F.col("target_sha"), "unchanged")
        .otherwise("changed")
    )
    out = both.select("filename", kind.alias("change_type"), "source_sha", "target_sha", F.lit(None).cast("string").alias("old_name"))
    if renamed is None:
        return out
    names = renamed.select(F.explode(F.array("old_name", "filename")).alias("filename")).distinct()
    moved = renamed.select("filename", F.lit("renamed").alias("change_type"), F.col("sha").alias("source_sha"), F.col("sha").alias("target_sha"), "old_name")
    return out.join(names, "filename", "left_anti").unionByName(moved)


#: What a user may turn a proposed change into.
ALLOWED_CHANGES = [("new", "deleted"), ("deleted", "unchanged"), ("changed", "unchanged"), ("renamed", "unchanged")]


def diff_edit_errors(current: DataFrame, edited: DataFrame, allowed: list[tuple[str, str]] = ALLOWED_CHANGES) -> DataFrame:
    """file_key and error of edits that are no edit of the current diff: duplicates, unknown keys, forbidden moves."""
    twice = edited.groupBy("file_key").count().where("count > 1").select("file_key", F.lit("duplicate").alias("error"))
    unknown = edited.join(current, "file_key", "left_anti").select("file_key", F.lit("unknown").alias("error"))
    moves = current.select("file_key", F.col("change_type").alias("was")).join(edited, "file_key").where(F.col("was") != F.col("change_type"))
    legal = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    wrong = moves.where(~F.array_contains(legal, F.concat_ws(">", "was", "change_type"))).select("file_key", F.lit("transition").alias("error"))
    return twice.unionByName(unknown).unionByName(wrong).distinct()


def apply_diff(catalog: DataFrame, diff: DataFrame) -> DataFrame:
    """The catalog after a diff: filename, sha256, deleted."""
    moved = diff.where("change_type = 'renamed'").select(F.col("old_name").alias("filename"), F.col("filename").alias("new_name"))
    state = diff.where("change_type in ('changed', 'deleted')").select("filename", "change_type", "source_sha")
    kept = catalog.join(moved, "filename", "left").join(state, "filename", "left")
    kept = kept.select(
        F.coalesce("new_name", "filename").alias("filename"),
        F.when(F.col("change_type") == "changed", F.col("source_sha")).otherwise(F.col("sha256")).alias("sha256"),
        (F.coalesce(F.col("change_type"), F.lit("")) == "deleted").alias("deleted"),
    )
    added = diff.where("change_type = 'new'").select("filename", F.col("source_sha").alias("sha256"), F.lit(False).alias("deleted"))
    return kept.unionByName(added)


def publish_newest(files: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each file live, all others deleted."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("version"), F.desc("id"))
    return files.withColumn("deleted", F.row_number().over(newest) > 1)


def priority_file(candidates: DataFrame, key: str) -> DataFrame:
    """Largest candidate of each group, the first of equals."""
    return candidates.groupBy(key).agg(F.max_by("id", F.struct("size", -F.col("ord"))).alias("id"))


# Changes to any keyed table: the next state is a function of the current one.


def patch(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``changes``: key and ``fields`` (map of column to text).  A field that is present applies, even as null."""
    fields = changes.select(F.col(key).alias("__key"), F.col("fields").alias("__fields"))
    joined = table.join(fields, table[key] == F.col("__key"), "left")
    new = [
        F.when(F.map_contains_key("__fields", F.lit(f.name)), F.col("__fields")[f.name].cast(f.dataType)).otherwise(table[f.name]).alias(f.name)
        if f.name != key
        else table[key]
        for f in table.schema
    ]
    return joined.select(*new)


def soft_delete(table: DataFrame, condition: Column) -> DataFrame:
    return table.withColumn("deleted", F.coalesce(condition, F.lit(False)) | F.col("deleted"))


def replace_project(table: DataFrame, new: DataFrame, project) -> DataFrame:
    return table.where(~F.col("project_id").eqNullSafe(F.lit(project))).unionByName(new)


def get_or_create(existing: DataFrame, wanted: DataFrame, key: str, *always: str) -> DataFrame:
    """Keys to add: those wanted (and ``always``) that do not exist."""
    names = wanted.select(key)
    if always:
        names = names.unionByName(wanted.sparkSession.createDataFrame([(a,) for a in always], names.schema))
    return names.where(F.col(key).isNotNull()).distinct().join(existing.select(key), key, "left_anti")
