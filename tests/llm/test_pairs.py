"""Near-duplicate operators against brute force, and their edge cases."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import embedding_dedup, ngram_join
from folioflow.llm.common import connected_components


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingles(text, n=5):
    w = (text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_jaccard(docs, threshold=0.8):
    sets = {d: shingles(t) for d, t in docs.items()}
    held = defaultdict(list)
    links = []
    for d, s in sets.items():
        common = Counter(o for g in s for o in held[g])
        links += [(o, d) for o, c in common.items() if c >= threshold * (len(s) + len(sets[o]) - c) - 1e-9]
        for g in s:
            held[g].append(d)
    return links


def check_jaccard(spark, docs, **params):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r["doc_id"]: r for r in ngram_join.jaccard_classes(df, **params).collect()}
    links = brute_jaccard(docs)
    degree = Counter(x for pair in links for x in pair)
    least = components(docs, links)
    assert len(found) == len(docs)
    for d in docs:
        assert (found[d]["n_links"], found[d]["component_id"], found[d]["kept"]) == (degree[d], least[d], least[d] == d), d


def near_copies(n, words=200, seed=1):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    out = []
    for i in range(n):
        w = list(base)
        w[int(rng.integers(words))] = f"x{i}"
        out.append(" ".join(w))
    return out


def test_jaccard_matches_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    check_jaccard(spark, docs)


def test_jaccard_large_group_in_blocks(spark):
    texts = near_copies(40) + near_copies(5, seed=2) + ["short one", "short one", "", None, "   "] + ["same " * 30] * 7
    check_jaccard(spark, dict(enumerate(texts)), block=8)


def test_windows_verify_candidates_alone(spark):
    """Overlapping windows, none at 0.8: chained collisions make one component, but only pairs with a common band count."""
    words = [f"w{i}" for i in np.random.default_rng(4).permutation(2000)]
    docs = {i: " ".join(words[i * 3 : i * 3 + 60]) for i in range(300)} | {1000 + i: t for i, t in enumerate(near_copies(30))}
    check_jaccard(spark, docs, block=16, block_bytes=4000)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    classes = ngram_join.signatures(df, n=5, bands=30, rows=6).withColumn("id", F.xxhash64("key"))
    bands = {r["id"]: set(enumerate(r["bands"])) for r in classes.collect()}
    sharing = {(a, b) for a in bands for b in bands if a < b and bands[a] & bands[b]}
    placed = ngram_join.block_pairs(classes.withColumn("copies", F.lit(1)), block=16, block_bytes=1 << 25).withColumn("id", F.xxhash64("key"))
    groups = defaultdict(list)
    for r in placed.collect():
        groups[r["cluster"], r["bi"], r["bj"]].append((r["id"], r["own"]))
    met = Counter(
        (min(a, b), max(a, b)) for (_, bi, bj), m in groups.items() for i, (a, x) in enumerate(m) for b, y in m[:i] if (bi == bj or x != y)
    )
    assert sharing <= set(met) and all(met[p] == 1 for p in sharing)
    left = np.array([[1, 2], [3, 4], [5, 6]])
    assert ngram_join.shared_bands(left, np.array([[9, 2], [4, 3]])).tolist() == [[True, False], [False, False], [False, False]]


def test_verified_pairs_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(40)]
    for share in (0.02, 0.5):
        mask = rng.random((25, 15)) < share
        found = ngram_join.verified(sets[:25], sets[25:], mask, 0.4)
        for i in range(25):
            for j in range(15):
                a, b = sets[i], sets[25 + j]
                assert found[i, j] == (mask[i, j] and len(np.intersect1d(a, b)) >= 0.4 * len(np.union1d(a, b)))


def test_jaccard_edges(spark):
    df = spark.createDataFrame(
        [(None, "a b c d e f", 1), (None, "a b c d e f", 2), (3, "a b c d e f", 3), (3, "a b c d e f", 3), (4, None, 4)],
        "doc_id long, text string, key int",
    )
    rows = ngram_join.jaccard_classes(df.select("doc_id", "text")).collect()
    assert sorted((r["doc_id"] or -1, r["n_links"], r["component_id"]) for r in rows) == [(-1, 3, 3), (-1, 3, 3), (3, 3, 3), (3, 3, 3), (4, 0, 4)]
    kept = ngram_join.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, "a b c d e f"), (4, None)]
    assert ngram_join.jaccard_classes(df.limit(0)).count() == 0


def test_band_count_meets_recall():
    for rows in (3, 5, 6, 8):
        bands = ngram_join.band_count(0.8, rows, 0.999)
        assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_linked_is_exact_over_slices():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    found = ngram_join.linked(sets, 0.5, width=7)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert found[i, j] == (len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)))


def check_embeddings(spark, rows, **params):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    found = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, **params).collect()}
    usable = {}
    for i, label, v in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            m = np.array(v, np.float32).astype(float)
            usable[i] = (label, m / np.linalg.norm(m))
    links = [
        (a, b)
        for a in usable
        for b in usable
        if a < b and usable[a][0] == usable[b][0] and len(usable[a][1]) == len(usable[b][1]) and usable[a][1] @ usable[b][1] >= 0.98
    ]
    degree = Counter(x for p in links for x in p)
    least = components([r[0] for r in rows], links)
    for i, _, _ in rows:
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (degree[i], least[i], least[i] == i), i


def vectors(n, groups, seed=3, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    out = []
    for i in range(n):
        v = centres[i % groups] + rng.standard_normal(dims) * (0.12 if i % 3 else 0.0)
        out.append((i, i % groups % 4, [float(x) for x in v]))
    return out


@pytest.mark.parametrize("block", [16, 1024])
def test_embeddings_match_brute_force(spark, block):
    rows = vectors(600, 60) + [(700 + i, 1, [1.0] * 16) for i in range(60)]
    check_embeddings(spark, rows, cell_rows=8, block=block, target_recall=0.9999)


def test_embedding_recall_on_table(spark, sf):
    rows = [(r["vec_id"], r["label"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_embeddings(spark, rows)


def test_embeddings_of_two_lengths(spark):
    rows = vectors(300, 30) + [(1000 + i, label, v) for i, label, v in vectors(200, 20, dims=9)]
    check_embeddings(spark, rows, cell_rows=8, target_recall=0.9999)


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, None, [1.0, 0.0]), (1, 1, None), (2, 1, [0.0, 0.0]), (3, 1, [nan, 1.0]), (4, 1, [inf, 1.0]), (5, 1, [None, 1.0]),
        (6, 1, [1.0, 0.0]), (7, 1, [2.0, 0.0]), (8, 2, [1.0, 0.0]), (9, 1, []), (10, 1, [1.0, 0.0, 0.0]), (11, 1, [3e38, 0.0]), (12, 1, [1e-38, 0.0]),
    ]
    check_embeddings(spark, rows)
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (None, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<float>")
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(twice).collect()) == [(0, 2, 1), (1, 2, 1), (1, 2, 1)]


def test_multi_sequence_order():
    rng = np.random.default_rng(5)
    a, b = np.sort(rng.random(9)), np.sort(rng.random(7))
    found = [a[i] + b[j] for i, j in embedding_dedup.multi_sequence(a, b, 1.1)]
    every = sorted(x + y for x in a for y in b if x + y <= 1.1)
    assert np.allclose(found, every)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
