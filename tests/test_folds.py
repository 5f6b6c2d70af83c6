"""Folds, plug-ins and enrichment on hand-made cases."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import models
from folioflow.operators import enrich, folds, layout
from folioflow.operators.chunks import merge_small


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=80), st.integers(2, 20))
def test_split_keeps_all_but_marks(text, size):
    parts = folds.split_text(text, size)
    # a closed piece hands its last unit on, which may then stand beside a unit that just fits
    assert all(0 < len(p) < 2 * size for p in parts)
    held = iter("".join(c for p in parts for c in p if c in "ab"))
    assert all(c in held for c in text if c in "ab")


def test_split_closes_above_the_size_and_hands_on_one_unit():
    assert folds.split_text("aaaa bbbb", 9) == ["aaaa bbbb"] and folds.split_text("aaaa bbbb", 8) == ["aaaa", "aaaa bbbb"]
    assert folds.split_text("aa bb cc dd", 6, overlap=2) == ["aa bb", "bb cc", "cc dd"]
    assert folds.split_text("aa bb cc dd", 6, overlap=0) == ["aa bb", "bb cc", "cc dd"]
    assert folds.split_text("a b c d e f", 5, overlap=3) == ["a b c", "b c d", "c d e", "d e f"]
    assert folds.split_text("xx\n\nyyyyyyyy zz", 6) == ["xx", "yyyyyy", "yyy", "zz"]
    assert folds.split_text("abcdef", 3) == ["abc", "cde", "ef"]


def test_long_texts_are_split_in_linear_time():
    import time

    began = time.time()
    assert len(folds.split_text("x" * 400_000, 2000)) > 200 and time.time() - began < 20


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n", max_size=80), st.integers(1, 20))
def test_oversized_parts_join_to_the_text(text, most):
    parts = folds.split_oversized(text, most)
    assert "".join(parts) == text and all(len(p) <= most + 1 for p in parts) and (all(parts) or parts == [""])


def test_oversized_parts_end_with_the_separator():
    assert folds.split_oversized("aaa\n\nbbb", 6) == ["aaa\n\n", "bbb"] and folds.split_oversized("", 6) == [""]
    assert folds.split_oversized("aaa\nbbb ccc", 6) == ["aaa\n", "bbb cc", "c"] and folds.split_oversized("a\n\nbbbbbbbb", 8) == ["a\n\nbbbbb", "bbb"]


def plain_leaders(hashes, most):
    found, out = [], []
    for i, h in enumerate(hashes):
        own = next((j for j in found if ((h ^ hashes[j]) & (2**64 - 1)).bit_count() <= most), i)
        if own == i:
            found.append(i)
        out.append(own)
    return out


def test_leaders_join_the_first_near_one(spark):
    """Rounds over all images give what one scan gives: chains, many equal hashes, random near ones, several documents."""
    import random

    rng = random.Random(1)
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    chain = [signed((1 << i) - 1) for i in range(40)]
    base = [rng.getrandbits(64) for _ in range(12)]
    near = [signed(rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 7))) % 2**64) for _ in range(250)]
    lists = {1: [0, 1, 3, 0b1111, -1, -2], 2: chain, 3: chain[::-1], 4: near, 5: [0] * 60 + [1] * 60 + [7] * 5, 6: []}
    images = spark.createDataFrame([(d, i, h) for d, hs in lists.items() for i, h in enumerate(hs)] + [(7, 0, None), (7, 1, None), (None, 3, 5)], "doc_id int, item int, phash long")
    for most in (1, 8):
        found = {(r["doc_id"], r["item"]): r["leader"] for r in layout.image_leaders(images.repartition(5), most).collect()}
        expected = {(d, i): own for d, hs in lists.items() for i, own in enumerate(plain_leaders(hs, most))} | {(7, 0): 0, (7, 1): 1, (None, 3): 3}
        assert found == expected


def test_ordered_matches_never_move_back():
    before = [("a", [1]), ("b", [2]), ("a", [3]), ("c", [9])]
    assert folds.ordered_matches(before, [("a", [3]), ("a", [1]), ("c", []), ("x", [0])]) == [2, 2, 3, 3]
    # nothing scores: the pointer stays, and its chunk is the match
    assert folds.ordered_matches(before, [("x", []), ("b", [2]), ("x", [7])]) == [0, 1, 1]
    assert folds.ordered_matches([], [("a", [1])]) == [-1]


def test_match_and_leaders_as_tables(spark):
    c = spark.createDataFrame([("d", i, "p", [i]) for i in range(5)], "document_id string, seq int, toc_path string, pages array<int>")
    found = {r["seq"]: r["matched_seq"] for r in folds.match_enrichment(c, c.where("seq > 1")).collect()}
    assert found == {2: 2, 3: 3, 4: 4}
    images = spark.createDataFrame([(1, 0, 0), (1, 1, 255), (1, 2, 1)], "doc_id int, item int, phash long")
    assert {r["item"]: r["leader"] for r in layout.image_leaders(images).collect()} == {0: 0, 1: 0, 2: 0}


def test_batches_fall_back_one_by_one():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        return [t.upper() for t in texts] if len(texts) == 1 and texts[0] != "none" else []

    assert models.in_batches(flaky, ["a", "none", "b"], 2, default="?") == ["A", "?", "B"] and calls == [2, 1, 1, 1]


def test_model_column_sanitizes_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "x<|im_end|>y. z"), (2, None)], "i int, t string")
    summarize = models.model_column(models.first_sentence, T.StringType())
    assert [r[0] for r in df.orderBy("i").select(summarize(F.col("t"))).collect()] == ["xy", None]
    assert models.overlap_rating()(["a b\ta c", "\t"]) == [33, 0]


def test_grid_leaves_out_covered_cells(spark):
    cells = [(1, 0, 0, 2, 1, True, "a&b"), (1, 0, 1, 1, 2, False, "c"), (1, 1, 2, 1, 1, False, None)]
    df = spark.createDataFrame(cells, "table_id int, row int, col int, row_span int, col_span int, header boolean, text string")
    html = enrich.grid_html(df).first()["html"]
    assert html == '<table><tr><th rowspan="2">a&amp;b</th><td colspan="2">c</td></tr><tr><td></td><td></td></tr></table>'


def test_summary_keeps_places(spark):
    old = spark.createDataFrame([("a", "1", 5, 0), ("b", "2", 5, 1)], "document_name string, summary string, duration int, pos int")
    new = spark.createDataFrame([("c", "3", 1, 0), ("a", "4", 1, 1)], "document_name string, summary string, duration int, pos int")
    rows = enrich.upsert_summary(old, new).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [("a", "4", 6, 0), ("b", "2", 5, 1), ("c", "3", 1, 2)]


def test_small_chunks_join_in_order(spark):
    """Against a plain loop: nulls, empty texts, repeated rows of one length, a rest after the last cut, one long text."""
    generator = random.Random(5)
    texts = {k: [generator.choice([None, "", "ab", "abcde", "x" * 30]) for _ in range(generator.randrange(1, 25))] for k in range(60)}
    rows = [(k, i, t) for k, held in texts.items() for i, t in enumerate(held)]
    generator.shuffle(rows)
    expected = []
    for k, held in texts.items():
        runs, run = [], []
        for text in held:
            run.append(text)
            if sum(len(t or "") for t in run) >= 12:
                runs.append(run)
                run = []
        if run:
            runs = [*runs[:-1], runs[-1] + run] if runs else [run]
        expected += [(k, i, "\n".join(t for t in r if t is not None), len(r)) for i, r in enumerate(runs)]
    chunks = spark.createDataFrame(rows, "document_id int, seq int, text string")
    assert sorted(map(tuple, merge_small(chunks, 12).collect())) == expected
    assert merge_small(chunks.limit(0)).count() == 0
