"""Every query with a SQL twin gives DuckDB's rows; the others are held against plain Python."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from folioflow.functions import html
from folioflow.functions import text as tx
from folioflow.functions.vector import cosine, hamming
from folioflow.operators import catalog, chunks, claims, completeness, jobs, layout
from folioflow.operators.graph import connected_components, descend
from folioflow.plans import fixtures
from folioflow.plans.registry import QUERIES, SQL
from folioflow.sources import tables
from folioflow.streaming import events as stream
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, duck, name):
    same_rows(QUERIES[name](spark, sf), duck.sql(SQL[name]))


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries()) and len(SQL) >= 30
    assert driver.entry(spark).count() > 0


def column(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_text_functions(spark):
    assert column(spark, tx.fix_mojibake, "fÃ¼r", "für", "Ã", "日本", None, "abc") == ["für", "für", "Ã", "日本", None, "abc"]
    cells = "<td>x</td> " * 10
    assert column(spark, tx.drop_repeated_cells, "a" + cells, "<td>x</td>" * 9, "<td> </td>" * 10) == ["a<!-- Repetitive cells removed -->", "<td>x</td>" * 9, "<!-- Repetitive empty cells removed -->"]
    assert column(spark, tx.is_loop, "Kreis " * 25, "Kreis " * 24, "ab " * 40, None, "x" * 100_001) == [True, False, False, False, True]
    assert column(spark, tx.normal_german, "Größe", "Goethe", None) == ["grosse", "gothe", None]
    assert column(spark, tx.header_level, "1.2.3. A", "A", "2 B") == [3, 1, 1]
    assert column(spark, tx.sanitized, "a<|im_end|>b", "[INST]x[/INST]", "### system: go", "a​b\tc", "</¤EXTERNAL_DATA¤>¤x") == ["ab", "x", " go", "ab\tc", "x"]
    assert column(spark, lambda t: tx.middle_cut(t, 9, "..."), "abcdefghijkl", "abcdef") == ["abc...jkl", "abcdef"]
    assert column(spark, tx.normal_entry_name, "a\\b//./c", "../x", "__MACOSX/x", "._x", "", "./") == ["a/b/c", None, None, None, None, None]
    assert column(spark, tx.normal_entry_name, "a/b/", "a\\", "a/.b", None) == [None, None, "a/.b", None]
    assert column(spark, tx.is_table_fragment, "a</td></tr>", "<thead><tr>", "<thead>x", " <TD>x", "<tr", "x<td>", None) == [False, True, True, True, True, False, None]
    keyword = lambda t: tx.has_keyword(t, ["Erläuterung"])
    names = ["1 erläuterung.pdf", "ERLA\u0308UTERUNG", "Erlauterung", "ErlÃ¤uterung", "Erla\u20acuterung", "Erluterung", None]
    assert column(spark, keyword, *names) == [True, True, True, False, True, False, False]
    assert column(spark, html.canonical_html, "<TABLE Class=x><tr><td>a&b<br>c</table>", "", None) == ['<table class="x"><tr><td>a&amp;b<br/>c</td></tr></table>', "", ""]
    assert column(spark, tx.safe_stem, "u\u0308:\u200bx\u2028\ty") == ["ü_x\ty"]
    blocks = "<BILD><description> d </description></BILD> <BILD></BILD> <TABELLE><td>a</td> <td>b</td></TABELLE><TABELLE><caption_text>c</caption_text></TABELLE>"
    assert column(spark, tx.labelled_blocks, blocks) == ["[Bild: d] [Bild] [Tabelle: a b][Tabelle: c]"]
    assert column(spark, tx.summaries_only, "<BILD><summary> s </summary></BILD>|<BILD>x</BILD>|<TABELLE><summary> </summary><td>a</td></TABELLE>") == [" s ||a"]
    assert column(spark, tx.clean_transcription, "a\n-----------\n|---|---|\n\n\n\nb") == ["a\n\nb"]
    assert column(spark, tx.page_numbers, 'x<seite nummer="3" />y<seite nummer="12"/>', "") == [[3, 12], []]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], 5, 6), ([0.0, 0.0], [1.0, 1.0], -1, 0)], "a array<double>, b array<double>, x long, y long")
    rows = df.select(cosine(F.col("a"), F.col("b")).alias("c"), hamming(F.col("x"), F.col("y")).alias("h")).collect()
    assert [round(r["c"], 6) for r in rows] == [0.707107, 0.0] and [r["h"] for r in rows] == [2, 64]


def test_renames_follow_sequence_matching(spark):
    old = spark.createDataFrame([("d/report-a.txt", "1"), ("d/zzz.txt", "2"), ("e/report-b.txt", "3"), ("d/same.txt", "4")], "filename string, sha256 string")
    new = spark.createDataFrame([("d/report-a2.txt", "1"), ("d/report-a3.txt", "1"), ("d/completely.pdf", "2"), ("d/report-b.txt", "3"), ("d/same.txt", "4")], "filename string, sha256 string")
    found = {(r["old_name"], r["filename"]) for r in catalog.renames(new, old).collect()}
    assert found == {("d/report-a.txt", "d/report-a2.txt"), ("d/report-a.txt", "d/report-a3.txt")}
    diff = {r["filename"]: r["change_type"] for r in catalog.snapshot_diff(new, old, catalog.renames(new, old)).collect()}
    assert diff["d/report-a2.txt"] == "renamed" and "d/report-a.txt" not in diff and diff["d/zzz.txt"] == "deleted" and diff["d/same.txt"] == "unchanged"
    assert SequenceMatcher(None, "d/report-a.txt", "d/report-a2.txt").ratio() >= 0.65


def test_swapped_names_are_one_rename(spark):
    old = spark.createDataFrame([("d/one.txt", "1"), ("d/ones.txt", "2")], "filename string, sha256 string")
    new = spark.createDataFrame([("d/one.txt", "2"), ("d/ones.txt", "1")], "filename string, sha256 string")
    assert [(r["old_name"], r["filename"], r["sha"]) for r in catalog.renames(new, old).collect()] == [("d/ones.txt", "d/one.txt", "2")]
    # the ratio is not symmetric: the staged name comes first
    a, b = "tide", "diet"
    assert SequenceMatcher(None, a, b).ratio() != SequenceMatcher(None, b, a).ratio()
    pair = spark.createDataFrame([(a, b)], "a string, b string").select(catalog.name_similarity("a", "b")).first()[0]
    assert pair == SequenceMatcher(None, a, b).ratio()


def test_confidence_rounds_as_python(spark):
    rows = [(1, 1, 0.285), (1, 2, 0.91), (2, 1, 2.675), (3, 1, None), (1, 3, 0.55)]
    found = {r["type_id"]: r["confidence"] for r in completeness.type_confidence(spark.createDataFrame(rows, "type_id int, ord int, confidence double")).collect()}
    assert found == {1: round(round(round(0.285, 2) * 0.91, 2) * 0.55, 2), 2: 2.67}


def test_confidence_of_a_hot_type_is_many_tables(spark):
    """Tables of runs give the fold's result bit by bit; types with factors outside 0 to 1 are folded in one task."""
    rng = random.Random(3)
    rows = [(0, i, rng.uniform(0.99, 1.0)) for i in range(4000)] + [(None, i, rng.random()) for i in range(3)]
    rows += [(t, i, rng.choice([rng.random(), 1.0, 0.995, 0.5, 0.0 if rng.random() < 0.02 else 0.97])) for t in range(1, 60) for i in range(rng.randint(1, 12))]
    rows += [(t, i, rng.uniform(-2, 3)) for t in range(60, 70) for i in range(9)] + [(70, 0, float("inf")), (71, 0, None)]
    df = spark.createDataFrame(rows, "type_id int, ord int, confidence double").repartition(5)
    expected = {}
    for t, _, x in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        expected[t] = round(expected[t] * x, 2) if t in expected else round(x, 2)
    found = {r["type_id"]: r["confidence"] for r in completeness.type_confidence(df).collect()}
    assert found == expected and len(found) == 72
    factors = [rng.random() ** 0.1 for _ in range(30)]
    table = completeness.steps_table(factors)
    for k in range(101):
        v = k / 100
        for x in factors:
            v = round(v * x, 2)
        assert table[k] / 100 == v


def test_patch_tells_absent_from_null(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "id int, name string, n int")
    c = spark.createDataFrame([(1, {"name": None}), (2, {"n": "9"})], "id int, fields map<string,string>")
    assert sorted(map(tuple, catalog.patch(t, c, "id").collect())) == [(1, None, 5), (2, "b", 9), (3, "c", 7)]


def test_zone_images_count_once_or_twice(spark):
    box = [0.0, 10.0, 5.0, 20.0]
    rows = [("d", 0, 0, "image", None, None, 7, box), ("d", 1, 0, "text", "Seite 1", None, None, box), ("d", 2, 1, "text", "Seite 2", None, None, box), ("d", 3, 1, "text", "Seite 2", None, None, [0.0, 400.0, 5.0, 410.0])]
    items = spark.createDataFrame(rows, "doc_id string, item int, page int, type string, text string, table_body string, phash long, bbox array<double>")
    assert [r["item"] for r in layout.recurring(items).collect()] == [2]
    assert sorted(r["item"] for r in layout.recurring(items, double_count_zone_images=True).collect()) == [0, 2]


def test_neighbours_do_not_depend_on_blocks(spark, sf):
    c = fixtures.claims(spark, sf)
    one, many = (claims.neighbours(c, lower=0.2, upper=0.4, block=b).collect() for b in (10_000, 40))
    key = lambda r: (r["claim_id"], r["spec"], r["rank"], r["other_id"], round(r["score"], 9))
    assert len(one) > 100 and sorted(map(key, one)) == sorted(map(key, many))


def test_blocks_that_cannot_reach_each_other_do_not_meet(spark):
    """On clustered claims most pairs of blocks are left out, and the neighbours are those of a plain ranking."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = []
    for i in range(600):
        vector = centres[i % 12] + rng.normal(size=12) * (0.03 if i % 3 else 0.06)
        rows.append((i, i % 2, f"d{rng.integers(0, 20)}", int(rng.integers(0, 9)), bool(rng.random() < 0.3), [float(x) for x in vector]))
    rows += [(1000, 0, "d1", 1, True, [0.0] * 12), (1001, 0, "d1", 1, True, None), (1002, 1, "d2", 3, False, [1.0, 2.0]), (1003, 5, "d9", 1, True, [1.0] * 12)]
    c = spark.createDataFrame(rows, "claim_id int, project_id int, document_id string, seq int, priority boolean, vector array<double>")
    specs = (claims.Spec(3), claims.Spec(2, priority_only=True, skip_local=True), claims.Spec(2, same_document=True))
    for lower, upper in ((0.5, 0.98), (0.8, 2.0)):
        found = sorted((r["claim_id"], r["spec"], r["rank"], r["other_id"], round(r["score"], 9)) for r in claims.neighbours(c, specs=specs, lower=lower, upper=upper, block=15).collect())
        expected = []
        for i, p, d, q, _, v in rows:
            for number, spec in enumerate(specs, 1):
                near = []
                for j, p2, d2, q2, first, w in rows:
                    if j == i or p2 != p or v is None or w is None or len(v) != 12 or len(w) != 12 or not any(v) or not any(w):
                        continue
                    if (spec.same_document and d != d2) or (spec.skip_local and d == d2 and abs(q - q2) <= 1) or (spec.priority_only and not first):
                        continue
                    score = float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
                    if score >= lower:
                        near.append((-score, j))
                expected += [(i, number, k, j, round(-s, 9)) for k, (s, j) in enumerate(sorted(near)[: spec.limit], 1) if -s <= upper]
        assert found == sorted(expected) and len(found) > 300
    sizes = c.groupBy("project_id").agg(F.count("*").alias("n"))
    placed = claims.placed_in_blocks(c, sizes, 15, 256)
    inside = claims._best(placed.withColumn("own", F.col("block")).withColumn("bi", F.col("block")).withColumn("bj", F.col("block")), specs, 0.8)
    n = placed.groupBy("project_id").agg(F.countDistinct("block").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0]
    met = claims.block_pairs(placed, inside, specs, 0.8).count()
    assert 0 < met < n * 0.5


def test_neighbour_kinds_and_bounds(spark):
    rows = [(1, 0, "a", 1, False, [1.0, 0.0]), (2, 0, "a", 2, False, [1.0, 0.01]), (3, 0, "a", 5, False, [1.0, 0.5]), (4, 0, "b", 1, True, [1.0, 0.6]), (5, 9, "b", 1, True, [1.0, 0.0]), (6, 0, "a", 7, False, [0.0, 0.0])]
    c = spark.createDataFrame(rows, "claim_id int, project_id int, document_id string, seq int, priority boolean, vector array<double>")
    found = {(r["claim_id"], r["spec"], r["other_id"]) for r in claims.neighbours(c).collect()}
    # 2 is 1's best of its document but above the bound; 5 is in another project; 6 has no direction
    assert {f for f in found if f[0] == 1} == {(1, 1, 4), (1, 3, 3)}
    assert not any(5 in f[::2] or 6 in f[::2] for f in found)


def test_clusters_are_cut_and_singletons_stay(spark):
    pairs = spark.createDataFrame([(i, 100 + i, 101 + i) for i in range(7)] + [(50, 1, 2)], "pair int, claim_a_id int, claim_b_id int")
    none = spark.createDataFrame([], "claim_id int, other_id int")
    found = claims.clusters(pairs, connected_components(claims.pair_edges(pairs, none))).collect()
    assert sorted((r["cluster"], r["members"], r["n_dropped"]) for r in found) == [(0, [0, 1, 2, 3, 4], 2), (50, [50], 0)]


def test_heading_stack_and_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\n## B\n#### C\n## D\n# E\ntext"), (2, "  # no head")], "doc_id int, markdown string")
    found = {(r["doc_id"], r["title"]): r["parent"] for r in chunks.heading_parents(chunks.header_nodes(docs)).collect()}
    assert found == {(1, "A"): None, (1, "B"): 2, (1, "C"): 3, (1, "D"): 2, (1, "E"): None}
    rows = sorted((r["section"], r["h1"], r["h2"]) for r in chunks.sections(docs).where("doc_id = 1").collect() if r["section"])
    assert rows == [(1, "A", None), (2, "A", "B"), (3, "A", "D"), (4, "E", None)]


def test_page_parts_drop_what_precedes_the_first_mark(spark):
    mark = lambda n: f'<seite nummer="{n}" />'
    text = "lost" + "".join(f"{mark(i)}p{i}" for i in range(1, 8))
    docs = spark.createDataFrame([(1, text), (2, "none")], "doc_id int, markdown string")
    rows = {r["doc_id"]: r["p"] for r in docs.select("doc_id", chunks.page_parts(F.col("markdown")).alias("p")).collect()}
    assert rows[2] == [] and "".join(rows[1]) == text.removeprefix("lost") and len(rows[1]) == 2
    loose = spark.createDataFrame([(1, 'x<seite  nummer = "1"/>aaaa\nbb<seite nummer="2" />c')], "doc_id int, markdown string")
    cut = loose.select(chunks.page_parts(F.col("markdown"), 1, most=28).alias("p")).first()["p"]
    assert cut == ['<seite  nummer = "1"/>aaaa\n', "bb", '<seite nummer="2" />c']


def test_tree_levels(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "node int, parent int")
    assert sorted((r["ancestor"], r["node"], r["depth"]) for r in descend(nodes, 2).collect()) == [(1, 2, 1), (1, 3, 2), (2, 3, 1), (2, 4, 2), (3, 4, 1)]
    assert descend(nodes.where("node < 0")).count() == 0
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)], "node int, parent int")
    assert sorted((r["ancestor"], r["node"], r["depth"]) for r in descend(chain).collect()) == [(a, b, b - a) for a in range(100) for b in range(a + 1, 100)]
    with pytest.raises(ValueError, match="below itself"):
        descend(spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1)], "node int, parent int"))


def test_documents_and_errors(spark, tmp_path):
    chunk = lambda n, *pages: (f"c{n}", "text", {}, list(pages), [(f"s{n}", "t", {}, list(pages))])
    docs = spark.createDataFrame([("a", 'x<seite nummer="7" />', None, [chunk(0, 1, 5), chunk(1, 9)]), ("b", "none", None, None)], tables.DOCUMENT)
    found = {(r["document_name"], r["seq"], r["error"]) for r in tables.chunks_up_to_page(docs, 3).collect()}
    assert found == {("a", 0, None), ("b", None, "not found")} and tables.sub_chunks_up_to_page(docs, 3).count() == 1
    tables.write_documents(docs, str(tmp_path / "out"))
    back = spark.read.schema(tables.DOCUMENT).json(str(tmp_path / "out"))
    assert {r["document_name"]: r["pages"] for r in back.collect()} == {"a": 7, "b": None}


def test_streams_agree_with_batches(spark, sf):
    table = tables.table(spark, sf, "events")

    def run(make, mode):
        source = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        q = make(source).writeStream.outputMode(mode).format("memory").queryName("out").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.table("out")

    folded = run(lambda s: stream.fold_status_stream(fixtures.job_events(s)), "update")
    batch = jobs.fold_status(fixtures.job_events(table))
    assert sorted(map(tuple, folded.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    windows = run(stream.counts_by_window, "complete")
    hours = table.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").count()
    assert {(r["start"], r["event_type"], r["n"]) for r in windows.collect()} == {(r["w"]["start"], r["event_type"], r["count"]) for r in hours.collect()}
    assert run(stream.distinct_events, "append").count() == table.count()
    assert run(stream.sessions, "complete").agg(F.sum("n")).first()[0] == table.count()


def test_library_does_not_need_the_training_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['folioflow.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=re.sub(r"/tests/.*", "", __file__), check=True)
    assert int(out.stdout) == len(QUERIES)


def test_whole_headings_keep_every_character(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in tables.table(spark, sf, "documents").collect() if r["text"] is not None}
    parts = {}
    for r in QUERIES["w14_sections"](spark, sf).collect():
        parts.setdefault(r["doc_id"], []).append((r["section"], r["text"]))
    for k, text in texts.items():
        marked = [("# ", "", "## ", "")[i % 4] + x for i, x in enumerate(text.split("\n"))]
        assert "\n".join(t for _, t in sorted(parts[k])) == "\n".join(marked)
    assert any(len(x) > 20 for t in texts.values() for x in t.split("\n")[::4])


def test_whole_symbols_reach_the_end(spark, sf):
    out = {r["doc_id"]: r["out"] for r in QUERIES["c11_plain_symbols"](spark, sf).collect()}
    plain = [r for r in tables.table(spark, sf, "documents").collect() if r["text"] and "$" not in r["text"]]
    assert any(len(r["text"]) > 50 for r in plain)
    assert all(out[r["doc_id"]].endswith(r["text"] + " § 7°F") for r in plain)


def test_clusters_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    centres = rng.standard_normal((90, 8))
    v = centres[rng.integers(0, 90, 150)] + 0.08 * rng.standard_normal((150, 8))
    rows = [(i, i % 2, i % 7, [float(x) for x in v[i]]) for i in range(150)]
    c = spark.createDataFrame(rows, "claim_id int, project_id int, document_id int, vector array<double>")
    pairs = [(i, i, (i * 37 + 2) % 150) for i in range(0, 150, 5)]
    p = spark.createDataFrame(pairs, "pair int, claim_a_id int, claim_b_id int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    root = {a[0]: a[0] for a in pairs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a, b in pairs:
        for y, d, e in pairs:
            # claims are compared whatever their documents, within a project
            if {a, b} & {d, e} or any(m % 2 == n % 2 and unit[m] @ unit[n] >= 0.95 for m in (a, b) for n in (d, e)):
                s, t = sorted((find(x), find(y)))
                root[t] = s
    groups = {}
    for x, _, _ in pairs:
        groups.setdefault(find(x), []).append(x)
    for block in (16, 1024):
        held = c.join(p.select(F.explode(F.array("claim_a_id", "claim_b_id")).alias("claim_id")).distinct(), "claim_id")
        found = claims.clusters(p, connected_components(claims.pair_edges(p, claims.similar_claims(held, block=block)))).collect()
        assert sorted((r["cluster"], r["members"], r["n_dropped"]) for r in found) == sorted((k, m[:5], max(len(m) - 5, 0)) for k, m in groups.items())
    assert 1 < len(groups) < len(pairs)


def test_contexts_speak_as_chunks_do(spark):
    rows = [("d", i, f"c{i}", "p" if i != 2 else "q", "text" if i % 2 else "image", f" t{i} ", "s" if i == 0 else None) for i in range(6)]
    c = spark.createDataFrame(rows, "document_id string, seq int, chunk_id string, toc_path string, chunk_type string, text string, summary string")
    found = {r["chunk_id"]: (r["prefix"], r["suffix"]) for r in claims.context_text(c).collect()}
    assert found["c3"] == ("[SUMMARY]\ns\n[/SUMMARY]\nt1", "") and found["c4"][1] == "t5"
    cut = {r["chunk_id"]: r["prefix"] for r in claims.context_text(c, most_before=10).collect()}
    assert cut["c3"] == "[S\n...[TRUNCATED]...\nMARY]\nt1"


def test_image_leaders_join_near_hashes(spark, sf):
    hashes, leaders, expected, distances = {}, {}, {}, set()
    for r in tables.table(spark, sf, "embeddings").orderBy("vec_id").collect():
        first = int("".join("01"[x > 0] for x in r["embedding"][:64]), 2)
        for item, h in ((2 * r["vec_id"], first), (2 * r["vec_id"] + 1, first ^ ((1 << r["vec_id"] % 13) - 1))):
            held = leaders.setdefault(r["label"], [])
            own = next((i for i in held if (h ^ hashes[i]).bit_count() <= 8), item)
            if own == item:
                held.append(own)
            else:
                distances.add((h ^ hashes[own]).bit_count())
            hashes[item], expected[item] = h, (r["label"], own)
    found = {r["item"]: (r["doc_id"], r["leader"]) for r in QUERIES["a2_image_leaders"](spark, sf).collect()}
    assert found == expected and distances == set(range(9))
