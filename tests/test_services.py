"""What changes of the services refuse, and what they leave alone."""

from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import completeness, jobs, services


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_overrides_check_types(spark):
    docs = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "file_id int, type_id int")
    types = spark.createDataFrame([(5,), (6,)], "type_id int")
    changes = spark.createDataFrame([(1, None), (2, 9), (3, 5), (4, 5)], "file_id int, type_id int")
    after, refused = services.override_assignments(docs, changes, types)
    assert rows(after) == [(1, None), (2, 6), (3, 5)] and rows(refused) == [(2, 9, "unknown type")]


def test_bulk_rules(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    changes = spark.createDataFrame([(1, "x"), (1, "y"), (9, "z")], "id int, name string")
    assert rows(services.bulk_errors(changes, now, "id", unknown_fails=True)) == [(1, "duplicate"), (9, "unknown")]
    assert rows(services.bulk_errors(changes, now, "id", unknown_fails=False)) == [(1, "duplicate")]
    assert rows(services.bulk_rename(now, changes.where("id = 9 or name = 'x'"), "id", "name")) == [(1, "x"), (2, "b")]
    new, refused = services.bulk_create(now, spark.createDataFrame([(3, "a"), (4, "c"), (5, "d"), (6, "d")], "id int, name string"), "name")
    assert rows(new.select("id", "name")) == [(4, "c")] and rows(refused) == [("a", "taken"), ("d", "duplicate")]


def test_projects_need_the_first_status(spark):
    projects = spark.createDataFrame([(1, "p", "", None), (2, "q", None, "x")], "project_id int, name string, a string, b string")
    none = spark.createDataFrame([(1, "other")], "status_id int, status_name string")
    assert rows(services.create_projects(projects, none, ["a", "b"])[2]) == [(1, "no status"), (2, "no status")]
    some = spark.createDataFrame([(7, services.NEW_STATUS)], "status_id int, status_name string")
    new, applicants, refused = services.create_projects(projects, some, ["a", "b"])
    assert rows(new) == [(1, "p", 7), (2, "q", 7)] and rows(applicants) == [(2, None, "x")] and refused.count() == 0
    after, unknown = services.set_status(new, spark.createDataFrame([(1, "gone"), (2, services.NEW_STATUS)], "project_id int, status_name string"), some)
    assert after.count() == 2 and rows(unknown) == [(1, "gone", "unknown status")]


def test_only_custom_types_are_renamed(spark):
    types = spark.createDataFrame([(1, "a", "custom", False), (2, "b", "template", False)], "type_id int, name string, origin string, resolved boolean")
    changes = spark.createDataFrame([(1, "x", None), (2, "y", True)], "type_id int, name string, resolved boolean")
    after, refused = services.patch_types(types, changes)
    assert rows(after) == [(1, "x", "custom", False), (2, "b", "template", True)] and rows(refused) == [(2, "not custom")]


def test_processing_starts_once_a_project(spark):
    archives = spark.createDataFrame([(1, 1, "OPEN"), (2, 1, "OPEN"), (3, 2, "RUNNING"), (4, 2, "OPEN"), (5, 3, "OPEN")], "id int, project_id int, workflow_status string")
    wanted = spark.createDataFrame([(1,), (2,), (4,)], "id int")
    after, refused = services.start_processing(archives, wanted, ["RUNNING"])
    assert {r["id"] for r in after.where("workflow_status = 'RUNNING'").collect()} == {1, 3} and rows(refused.select("id")) == [(2,), (4,)]
    back = services.set_archive_status(after, spark.createDataFrame([(1, "OPEN")], "id int, status string"))
    assert rows(back) == rows(archives)


def test_versions_and_uploads(spark):
    files = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 3, False)], "name string, version int, deleted boolean")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert rows(services.reserve_versions(files, wanted, ["name"])) == [("a", 2, True, True), ("b", 4, True, False), ("c", 1, True, False)]
    based = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "name string, based_on int")
    assert rows(services.version_conflicts(files, based, ["name"])) == [("a", 1, 3, True), ("b", 3, 4, False), ("c", None, 1, False)]
    uploads = spark.createDataFrame([("b", 4, True), ("c", 1, False)], "name string, version int, object_exists boolean")
    after, refused = services.confirm_uploads(files, uploads, ["name"])
    assert rows(after) == [("a", 1, False), ("a", 2, True), ("b", 3, True), ("b", 4, False)] and rows(refused) == [("c", "not uploaded")]


def test_notes_registrations_and_reads(spark):
    notes = spark.createDataFrame([(1, 1, False), (2, 1, True)], "note_id int, project_id int, resolved boolean").withColumn("created_at", F.col("note_id"))
    after, missing = services.resolve_notes(notes, spark.createDataFrame([(1,), (9,)], "note_id int"))
    assert after.where("resolved").count() == 2 and rows(missing) == [(9, "not found")]
    assert [r["note_id"] for r in services.newest_notes(notes, 1).collect()] == [2, 1]
    places = spark.createDataFrame([(1, "x"), (1, "w")], "note_id int, place string")
    assert [[o["place"] for o in r["occurrences"]] for r in services.notes_with_places(notes, places).collect()] == [["w", "x"], []]
    live = spark.createDataFrame([(1, False), (2, True)], "type_id int, deleted boolean")
    wanted = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 2, 0), (3, 1, 0)], "project_id int, type_id int, ord int")
    new, refused = services.register_projects(spark.createDataFrame([(3,)], "project_id int"), wanted, live)
    assert rows(new) == [(1, 1, 0)] and rows(refused) == [(2, "no template")]
    nested = spark.createDataFrame([("c", 0, ["t", "u"])], "name string, ord int, types array<string>")
    assert rows(services.create_templates(nested)[1]) == [("c", 0, "t"), ("c", 1, "u")]
    windows = spark.createDataFrame([("abcde",), ("",)], "t string").select(services.windows(F.col("t"), 2)).collect()
    assert [r[0] for r in windows] == [["ab", "cd", "e"], []]


def test_uploads_and_parts(spark):
    files = [("a.PDF", b"%PDF-1.7"), ("a.pdf", b"\xef\xbb\xbf#!/bin/sh"), ("a.pdf", b"GIF89a"), (".pdf", None), ("a.tar.pdf", None), ("a", b"%PDF")]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "i int, name string, content binary").orderBy("i")
    kinds = {".pdf": "application/pdf"}
    assert [r[0] for r in df.select(tx.upload_error(F.col("name"), F.col("content"), kinds, ["application/pdf"])).collect()] == [None, "script", "content", "extension", None, "extension"]
    parts = spark.createDataFrame([(1, 0, False, False, 9.0), (1, 50, False, True, 9.0), (2, 0, False, False, 30.0)], "document_id int, page_offset int, ok boolean, timed_out boolean, size_mb double")
    assert rows(jobs.part_actions(parts).select("document_id", "action", "error")) == [(1, "drop", None), (1, "rasterize", None), (2, "drop", "no part could be read")]
    assert completeness.type_confidence(spark.createDataFrame([], "type_id int, ord int, confidence double")).count() == 0
