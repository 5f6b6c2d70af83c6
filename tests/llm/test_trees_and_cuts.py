"""Merkle manifests, fill-in-middle cuts and paragraph sketches."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import fim, fingerprint, merkle, queries
from tests.conftest import same_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NEW = ["op11_merkle_manifest", "op12_fill_in_middle", "op13_fingerprints"]


@pytest.mark.parametrize("name", NEW)
def test_new_operators_match_sql(spark, sf, duck, name):
    same_rows(queries.queries()[name](spark, sf), duck.sql(queries.oracle_sql()[name]))


@pytest.mark.parametrize("name", NEW)
def test_new_operators_on_empty_tables(spark, name):
    docs = spark.createDataFrame([], DOCS)
    found = {"op11_merkle_manifest": merkle.document_manifest, "op12_fill_in_middle": lambda d: fim.digest(fim.transform(d)), "op13_fingerprints": fingerprint.fingerprints}[name](docs)
    assert found.count() == 0


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """Root, and for every node its siblings level by level as (before, after)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place // 16 * 16
            steps[i].append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + 16])))
        at = [place // 16 for place in at]
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], steps


def plain_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(enc(r[0]), enc(r[3]), enc(r[2]), enc(r[4]), enc(text))
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([g[2] for g in sorted(groups[s], key=lambda g: g[:3])]) for s in order}
    root, over = plain_tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, over, strict=True):
        subroot, steps = trees[s]
        for (_, _, own, r), mine in zip(sorted(groups[s], key=lambda g: g[:3]), steps, strict=True):
            low = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            acc = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1])) if low and r[1] is not None else own
            for before, after in mine + up:
                acc = sha(before, acc, after)
            proof = sha("".join(a + b for a, b in mine + up))
            out.append((str(r[0]), own, subroot, root, proof, acc, acc == root))
    return sorted(out)


def test_manifest_equals_plain_trees(spark):
    rows = [(i, f"Text {i} é", "en", "big", i) for i in range(1, 600)]
    rows += [(None, None, None, None, None), (7, "A", None, None, 3), (7, "A", None, None, 3), (8, "", "", "", 0), (9, "lone Ü", "de", "one", 1), (10, "x", "de", "große", 1)]
    rows += [(1000 + i, "T" * i, "fr", f"s{i % 19}", i) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS).withColumn("group", F.lit(1)).withColumn("node", F.lit("x"))
    found = merkle.document_manifest(df.repartition(7)).collect()
    ours = sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in found)
    assert ours == plain_manifest(rows)
    assert {r["verified"] for r in found} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_one_group_of_n(spark, n):
    rows = [(i, "t", None, "s", i) for i in range(n)]
    found = merkle.document_manifest(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in found) == plain_manifest(rows)


def test_proofs_are_real_outputs(spark):
    leaves = spark.createDataFrame([(i % 3, i, f"v{i}") for i in range(100)], "part long, at long, v string")
    found = merkle.manifest(leaves.withColumn("leaf", merkle.digest(F.col("v"))), "part", "at")
    held = found.select("part", (merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root")).alias("ok"), F.size("steps").alias("n"))
    assert [tuple(r) for r in held.groupBy("ok", "n").count().collect()] == [(True, 3, 100)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB é<PSM>\n🎉1", max_size=60), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_are_token_borders(text, h1, h2):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, low, high = fim.cut(text.encode(), h1, h2)
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    assert (n, low, high) == (len(tokens), len("".join(tokens[:a]).encode()), len("".join(tokens[:b]).encode()))


def test_select_over_blocks_and_stretches(monkeypatch):
    monkeypatch.setattr(fim, "STRETCH", 64)
    text = "ab é  c🎉" * 500 + "z" * 3000 + "."
    tokens, at = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), 0
    import numpy as np

    borders = fim.Borders(np.frombuffer(text.encode(), np.uint8))
    assert borders.total == len(tokens)
    for i, t in enumerate(tokens):
        assert borders.select(i) == at
        at += len(t.encode())
    assert borders.select(len(tokens)) == at


def test_fill_in_middle_edges(spark):
    texts = [None, "", "a", "<P>", "a<", "S>", "x <S", "é" * 50, "word " * 200_000, "no\x00nul"]
    rows = [(i, t, 5) for i in range(40) for t in texts] + [(None, "null id", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    out = fim.transform(df)
    held = out.select("doc_id", "text", "form", "output", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(held) == len(rows) and all(r["back"] == (r["text"] or "") for r in held)
    assert {r["form"] for r in held} == {"plain", "psm", "spm"} and {r["form"] for r in held if r["text"] in (None, "", "<P>")} == {"plain"}
    assert all(r["output"].startswith("<P>") for r in held if r["form"] == "psm")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 2**60 - 1), max_size=60), st.sets(st.integers(0, 2**60 - 1), max_size=60), st.sets(st.integers(0, 2**60 - 1), max_size=60)), min_size=1, max_size=5))
def test_differences_are_exact(spark, sets):
    rows = [(i, [*(a | shared)], [*(b | shared)]) for i, (a, b, shared) in enumerate(sets)]
    found = fingerprint.differences(spark.createDataFrame(rows, "id int, a array<bigint>, b array<bigint>")).collect()
    for i, a, b in rows:
        left = sorted(k for r in found if r["id"] == i for k in r["left"])
        right = sorted(k for r in found if r["id"] == i for k in r["right"])
        assert (left, right) == (sorted(set(a) - set(b)), sorted(set(b) - set(a)))


def test_many_differences_are_tried_again(spark):
    a = [int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in range(3000)]
    b = a[:1000] + [int(hashlib.md5(f"b{i}".encode()).hexdigest()[:15], 16) for i in range(1500)]
    found = fingerprint.differences(spark.createDataFrame([(1, a, b), (2, a, a), (3, a, a[:-2])], "id int, a array<bigint>, b array<bigint>")).collect()
    assert len(found) > 100 and len([r for r in found if r["id"] != 1]) == 2
    assert {k for r in found if r["id"] == 1 for k in r["left"]} == set(a) - set(b)
    assert {k for r in found if r["id"] == 1 for k in r["right"]} == set(b) - set(a)
    assert [sorted(r["left"]) for r in found if r["id"] == 3] == [sorted(a[-2:])]


def test_fingerprint_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "one\ntwo\nthree"), (4, "three\ntwo\none"), (4, "again"), (None, "x" * 7), (5, "line\n" * 9), (6, "\n".join(f"l{i}" for i in range(4000)))]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_chars int").repartition(3)
    found = fingerprint.fingerprints(df).collect()
    assert len(found) == len(rows)
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    assert [tuple(r) for r in by[2]][:1] * 2 == [tuple(r) for r in by[2]] and by[1][0]["fingerprint"] == by[2][0]["fingerprint"]
    assert by[3][0]["fingerprint"] in {r["fingerprint"] for r in by[4]}
    assert by[None][0]["edited_sha256"] == sha("xxxx") and by[1][0]["near_edited"] == by[1][0]["near_next"] == 1.0
    assert by[6][0]["n_chars"] == len(rows[-1][1]) and 0 < by[6][0]["near_edited"] < 1
    alone = fingerprint.fingerprints(df.where("doc_id = 3")).collect()
    assert [(r["near_next"], r["edited_sha256"]) for r in alone] == [(1.0, sha("one\ntwo" + "one\ntw"))]
    assert "PythonUDF" not in fingerprint.fingerprints(df)._jdf.queryExecution().toString()
