"""Steps whose cost must not outgrow their input."""

import numpy as np

from folioflow.operators import claims


def test_quotas_read_the_neighbours_once(spark):
    """The product of all claims is under the quotas three times; it is staged."""
    near = spark.createDataFrame([(1, 1, 1, 2, 0.3), (1, 3, 1, 2, 0.3), (1, 3, 2, 5, 0.25)], "claim_id int, spec int, rank int, other_id int, score double")
    dear = near.groupBy("claim_id").applyInPandas(lambda g: g, near.schema)
    merged = claims.quota_merge(dear)
    assert "FlatMapGroups" not in merged._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["pos"], r["other_id"]) for r in merged.collect()) == [(1, 2), (2, 5)]


def test_claims_without_a_document_are_local_where_they_are_next(spark):
    """As in SQL, where it is unknown whether they are of one document."""
    rows = [(1, 0, None, 1, True, [1.0, 0.0]), (2, 0, None, 2, True, [1.0, 1.0]), (3, 0, None, 9, True, [1.0, 1.2])]
    c = spark.createDataFrame(rows, "claim_id int, project_id int, document_id int, seq int, priority boolean, vector array<float>")
    assert {(r["claim_id"], r["spec"], r["other_id"]) for r in claims.neighbours(c).collect()} == {(1, 1, 3), (3, 1, 1)}


def test_tiles_give_the_best_and_the_smaller_id_of_equals(monkeypatch):
    monkeypatch.setattr(claims, "TILE", 16)
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(150, 6))
    unit[100:] = unit[:50]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    facts = {"code": np.arange(150), "document": np.arange(150) % 3, "seq": np.arange(150), "priority": np.arange(150) % 4 == 0, "unit": unit}
    specs = (claims.Spec(3), claims.Spec(2, same_document=True, skip_local=True), claims.Spec(2, priority_only=True))
    found = claims._nearest(facts, np.arange(150), np.arange(150), specs, 0.1)
    scores = np.einsum("ik,jk->ij", unit, unit).round(12)
    for k, spec in enumerate(specs, 1):
        ours = sorted((int(i), round(float(s), 9), int(j)) for rows, kinds, others, value in found for i, n, j, s in zip(rows, kinds, others, value) if n == k)
        expected = []
        for i in range(150):
            ok = [j for j in range(150) if j != i and scores[i, j] >= 0.1 and (not spec.same_document or i % 3 == j % 3) and not (spec.skip_local and i % 3 == j % 3 and abs(i - j) <= 1) and (not spec.priority_only or j % 4 == 0)]
            expected += [(i, round(float(scores[i, j]), 9), j) for j in sorted(ok, key=lambda j: (-scores[i, j], j))[: spec.limit]]
        assert ours == sorted(expected)


def test_similar_claims_link_whole_components_of_a_dense_group(spark):
    """A chain of near vectors and many copies, in blocks and in one: links join all of them, no more than one a claim and pair of blocks."""
    angles = [0.1 * i for i in range(10)] + [2.5] * 60
    rows = [(i, 0, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)]
    c = spark.createDataFrame(rows, "claim_id int, project_id int, vector array<float>")
    for block, most in ((1000, 69), (7, 69 * 8)):
        links = [(r["claim_id"], r["other_id"]) for r in claims.similar_claims(c, block=block).collect()]
        root = list(range(70))
        for _ in range(70):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        assert root == [0] * 10 + [10] * 60 and len(links) <= most
    # a claim travels to eight blocks at most, however many times the least size there are
    plan = claims.similar_claims(c, block=1)._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in plan and len(claims.similar_claims(c, block=1).collect()) <= 69 * 8


def test_text_columns_take_batches_of_bounded_rows_and_bytes(spark):
    """A batch holds whole texts: no more than 2000 rows, and few where they are long; the results are those of one batch."""
    from pyspark.sql import functions as F

    from folioflow.functions.batches import BATCH_BYTES, BATCH_ROWS, text_column

    column = text_column(lambda t: t.map(lambda _: len(t)), "int")
    small = spark.range(0, 9000, numPartitions=1).select(column(F.col("id").cast("string")).alias("n"))
    assert small.agg(F.max("n")).first()[0] == BATCH_ROWS
    large = spark.range(0, 40, numPartitions=1).select(column(F.repeat(F.concat(F.lit("x"), "id"), 500_000)).alias("n"))
    assert large.agg(F.max("n")).first()[0] * 1_000_000 <= 2 * BATCH_BYTES


def test_chunker_neither_sorts_nor_joins_texts(spark):
    """A document is cut inside its row: its text is sent once at most, to meet its contents."""
    from folioflow.operators import markdown

    docs = spark.createDataFrame([(0, "# 1 A\nx\n## B\ny"), (1, "__SPECIAL_ELEMENT_PLACEHOLDER_99999999999__ z")], "doc_id int, markdown string")
    items = spark.createDataFrame([(0, 0, "text", 1, "1 A")], "doc_id int, pos int, type string, text_level int, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan(markdown.chunk_documents(docs)) for step in ("Exchange", "Window", "Sort", "Join"))
    found = markdown.chunk_documents(docs, items)
    assert plan(found).count("Exchange") <= 2 and "Window" not in plan(found)
    # a number that no element has is no error
    assert [(r["doc_id"], r["chunk"], r["text"], r["toc_path"]) for r in found.orderBy("doc_id", "chunk").collect()] == [(0, 0, "# 1 A\nx", ["1 A"]), (0, 1, "## B\ny", ["1 A"]), (1, 0, " z", [])]


def test_files_are_joined_in_tasks_of_bounded_rows(spark, sf, duck, monkeypatch):
    """However few bytes the rows take; the results stay."""
    import __spark_entry__ as entry
    from pyspark.sql import functions as F

    from folioflow.plans import fixtures
    from folioflow.sources import tables

    from .conftest import same_rows

    monkeypatch.setattr(tables, "TASK_ROWS", 500, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = fixtures.files(spark, sf).select("id", "project_id").groupBy(F.spark_partition_id()).count()
        assert held.agg(F.max("count")).first()[0] <= 2 * 500
        found = entry.queries()["x3_replace_project"](spark, sf)
        # each side of both joins is dealt out once
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 4
        same_rows(found, duck.sql(entry.oracle_sql()["x3_replace_project"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
