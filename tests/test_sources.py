"""Archives, staged files and digests."""

import hashlib
import zipfile

import pytest

from folioflow.sources import archives, bucketed, documents


@pytest.fixture
def packed(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/a.txt", "a" * 100_000)
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("x/b.txt", "b" * 1000)
        z.writestr("empty", "")
        z.writestr("__MACOSX/y", "b")
        z.writestr("d/", "")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    return spark.read.format("binaryFile").load(f"file://{tmp_path}/*.zip")


def name(r):
    return r["path"].rsplit("/", 1)[1]


def test_zip_scan_and_guard(packed):
    rows = {(name(r), r["entry_name"]): r for r in archives.zip_entries(packed).collect()}
    # a bomb is refused by its directory, before anything is inflated
    assert rows["a.zip", None]["error"] == "compressed too well" and rows["bad.zip", None]["error"] and len(rows) == 6
    assert rows["b.zip", "x/b.txt"]["normal_name"] == "x/b.txt" and rows["b.zip", "__MACOSX/y"]["normal_name"] is None and rows["b.zip", "d/"]["sha256"] is None
    few = {name(r): r["error"] for r in archives.zip_entries(packed, most_entries=3).where("error is not null").collect()}
    assert few["b.zip"] == "too many entries"
    guard = archives.zip_guard(archives.zip_entries(packed, most_ratio=1e9).where("error is null")).collect()
    assert {name(r): r["accepted"] for r in guard} == {"a.zip": False, "b.zip": True}
    assert {name(r): r["total_size"] for r in guard} == {"a.zip": 100_000, "b.zip": 1001}


def test_one_archive_is_many_tasks(spark, tmp_path):
    """Entries are dealt by ranges of packed bytes; a damaged one is an error row beside the good ones."""
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_STORED) as z:
        for i in range(200):
            z.writestr(f"f{i}.bin", bytes([i]) * 5000)
    data = (tmp_path / "big.zip").read_bytes()
    at = data.index(bytes([77]) * 5000)
    (tmp_path / "big.zip").write_bytes(data[:at] + b"?" + data[at + 1 :])
    paths = spark.createDataFrame([(f"file://{tmp_path}/big.zip",), (f"file://{tmp_path}/none.zip",)], "path string")
    ranges = archives.dealt(archives.directories(paths).where("error is null"), 50_000)
    assert ranges.select("range").distinct().count() == 20
    found = {r["entry_name"]: r for r in archives.zip_entries(paths, range_bytes=50_000).collect()}
    assert len(found) == 201 and "FileNotFound" in found[None]["error"]
    assert "BadZipFile" in found["f77.bin"]["error"] and found["f77.bin"]["sha256"] is None
    assert all(found[f"f{i}.bin"]["sha256"] == hashlib.sha256(bytes([i]) * 5000).hexdigest() for i in range(200) if i != 77)


def test_staging(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for n, content in [("a/good.pdf", b"%PDF-1.7 one"), ("a//./good.pdf", b"%PDF-1.7 two"), ("../up.pdf", b"%PDF-1.7"), ("x.exe", b"%PDF-1.7"), ("fake.pdf", b"hello"), ("dir/", b""), ("broken.pdf", b"%PDF-1.7 abcdefghijklmnop")]:
            z.writestr(zipfile.ZipInfo(n), content)
    data = (tmp_path / "p.zip").read_bytes()
    (tmp_path / "p.zip").write_bytes(data.replace(b"abcdefghijklmnop", b"abcdefgXijklmnop", 1))
    (tmp_path / "bad.zip").write_bytes(b"")
    paths = spark.createDataFrame([(f"file://{tmp_path}/p.zip", "p1"), (f"file://{tmp_path}/bad.zip", "p1")], "path string, project string")
    stage = lambda: archives.stage_archives(paths, f"file://{tmp_path}/out", {".pdf": "application/pdf"}, ["application/pdf"], prefix=paths["project"]).collect()
    found = sorted((r["filename"] or "", r["success"], r["error_code"] or "") for r in stage())
    assert found == [("", False, "ZIP_INVALID"), ("a/good.pdf", True, ""), ("a/good.pdf", True, ""), ("broken.pdf", False, "UNREADABLE"), ("fake.pdf", False, "VALIDATION_FAILED"), ("x.exe", False, "VALIDATION_FAILED")]
    files = [str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert files == ["p1/a/good.pdf"] and (tmp_path / "out" / files[0]).read_bytes() == b"%PDF-1.7 one"
    # what is there stays
    (tmp_path / "out" / files[0]).write_bytes(b"older")
    assert sum(r["success"] for r in stage()) == 2 and (tmp_path / "out" / files[0]).read_bytes() == b"older"


def test_digests_of_files(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"x" * 3_000_000)
    (tmp_path / "e").write_bytes(b"")
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in "fe-"], "path string")
    found = {name(r): (r["sha256"], r["size"], r["error"] is None) for r in archives.file_digests(paths).collect()}
    assert found == {"f": (hashlib.sha256(b"x" * 3_000_000).hexdigest(), 3_000_000, True), "e": (hashlib.sha256(b"").hexdigest(), 0, True), "-": (None, None, False)}


def test_filters_reach_the_reader(spark, tmp_path):
    import json

    for d in range(30):
        chunks = [{"chunk_id": f"{d}-{i}", "page_content": "é" * i, "page_numbers": [i, i + 2], "sub_chunks": [{"chunk_id": "s", "page_content": "t", "page_numbers": None}]} for i in range(5)]
        (tmp_path / f"d{d}.json").write_text(json.dumps({"chunks": [*chunks, {"chunk_id": "bare"}]}))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "d99.json.part").write_text("{}")
    rows = documents.read_chunks(spark, f"file://{tmp_path}", page_size=7)
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 30 * 6 + 1
    one = rows.where("document_name = 'd3' and first_page <= 2 and page_content <> 'x'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    # what the reader holds is no filter of Spark's any more
    left = next(x for x in plan.split("\n") if "Filter" in x)
    assert "page_content" in left and "first_page" not in left and "document_name" not in left
    assert sorted(r["seq"] for r in one.collect()) == [0, 1, 2]
    assert one.rdd.getNumPartitions() == 1
    told = rows.where("document_name in ('d1', 'nowhere', 'broken') and first_page < 1").collect()
    assert sorted((r["document_name"], r["seq"] if r["seq"] is not None else -1, r["error"] is not None) for r in told) == [("broken", -1, True), ("d1", 0, False), ("nowhere", -1, True)]
    assert {r["error"] for r in told if r["document_name"] == "nowhere"} == {"not found"}
    assert documents.read_chunks(spark, f"file://{tmp_path}", names=["d2", "gone"]).count() == 7
    assert documents.read_chunks(spark, f"file://{tmp_path}/nothing").count() == 0


def test_documents_round_trip(spark, tmp_path):
    chunk = ("c", "text", [2, 3], [("s", "x", [2])])
    docs = spark.createDataFrame([("a", [chunk]), ("b", [])], "document_name string, chunks array<struct<chunk_id:string,page_content:string,page_numbers:array<int>,sub_chunks:array<struct<chunk_id:string,page_content:string,page_numbers:array<int>>>>>")
    documents.write_each(docs, f"file://{tmp_path}/out")
    found = documents.read_chunks(spark, f"file://{tmp_path}/out").collect()
    assert [(r["document_name"], r["seq"], r["first_page"], r["sub_chunks"][0]["page_numbers"]) for r in found] == [("a", 0, 2, [2])]


def test_upserts_write_only_what_they_touch(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    rows = [(i % 40, i, "old") for i in range(400)] + [(None, 1, "old")]
    bucketed.write_buckets(spark.createDataFrame(rows, "doc int, claim int, v string"), path, ["doc"], 16)
    files = lambda: {str(f.relative_to(tmp_path)): f.read_bytes() for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(3, 9000, "new"), (3, 9001, "new"), (77, 1, "new"), (None, 2, "new")], "doc int, claim int, v string")
    touched = bucketed.replace_groups(path, new, ["doc"], 16)
    after = files()
    kept = {f: b for f, b in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert 0 < len(touched) <= 3 and kept.items() <= after.items() and len(kept) > 8
    expected = sorted([str(r) for r in rows if r[0] not in (3, None)] + [str(tuple(r)) for r in new.collect()])
    assert sorted(str(tuple(r)) for r in bucketed.read_buckets(spark, path).collect()) == expected
    assert bucketed.replace_groups(path, new.limit(0), ["doc"], 16) == [] and files() == after
    # the same by a shuffle of both sides
    monkeypatch.setattr(bucketed, "MOST_KEYS", 0)
    bucketed.replace_groups(path, new, ["doc"], 16)
    assert sorted(str(tuple(r)) for r in bucketed.read_buckets(spark, path).collect()) == expected
