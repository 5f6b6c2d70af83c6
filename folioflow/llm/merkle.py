"""Merkle manifest of a dataset: a tree of hashes for each group of rows, and one tree over the groups' roots.

A level is one window: nodes are partitioned by group and parent index, and the ordered ``collect_list`` over the
whole frame (at most ``FANOUT`` nodes) is both the parent's preimage and the source of the node's siblings.  The first
node of each run stands for the parent, so a level has a sixteenth of the rows of the one below.  Proofs come down the
tree by joins on group and parent index: a group of any size spreads over as many keys as it has runs.

Cases: a null field is hashed as ``-``; a null group is a group of its own and comes first.  Rows of a group are in
ascending ``order``, null first; rows that tie there are in the order of their leaves, equal ones change places freely.
A group with one row has its leaf as root, a dataset with one group that group's root; their steps are empty.  An
empty table has no root and no rows.  Extra columns are not hashed and not returned; a document of any length is hashed
whole.  Groups are compared as text, bytewise.  Names that start with ``__`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, crc32_utf8, ranked, stage

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:binary,after:binary>>"


def field(value: Column) -> Column:
    """A field's part of a leaf: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' concatenation, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf(fields: dict[str, Column]) -> Column:
    return digest(*[field(c) for c in fields.values()])


def _joined(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(b""), lambda a, x: F.concat(a, x))


def with_runs(level: DataFrame) -> DataFrame:
    """``level`` (group, idx, n, node) with ``__run``: the nodes of the row's run, in order."""
    run = Window.partitionBy("group", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = level.withColumn("parent", F.floor(F.col("idx") / FANOUT))
    return level.withColumn("__run", F.collect_list("node").over(run))


def parents(level: DataFrame) -> DataFrame:
    """The next level: one row a run; the node of a group that has no other is kept."""
    first = with_runs(level).where(F.col("idx") % FANOUT == 0)
    above = F.when(F.col("n") > 1, digest(as_text(_joined(F.col("__run"))))).otherwise(F.col("node"))
    return first.select("group", F.col("parent").alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n"), above.alias("node"))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """All levels of the groups' trees, from ``nodes`` (group, idx, node) to the level where every group has one node."""
    counts = nodes.groupBy("group").agg(F.count("*").alias("n"))
    counts = stage(counts, "merkle-counts")
    most = counts.agg(F.max("n")).first()[0] or 0
    found = [stage(nodes.join(bounded(counts), "group"), "merkle-level")]
    while most > 1:
        found.append(stage(parents(found[-1]), "merkle-level"))
        most = -(-most // FANOUT)
    return found


def with_steps(tree: list[DataFrame], top: DataFrame, keep: list[str]) -> DataFrame:
    """The tree's lowest level with ``steps`` (siblings before and after the node, level by level) and ``keep`` of its group's row in ``top``.

    ``top``: group, steps from the group's root upwards, and the columns of ``keep``.
    """
    above = top.withColumn("idx", F.lit(0).cast("long"))
    for level in reversed(tree):
        # at the topmost level every group has one node, which has no siblings below its group's root
        place = (F.col("idx") % FANOUT).cast("int")
        before = _joined(F.slice("__run", F.lit(1), place))
        after = _joined(F.slice("__run", place + 2, F.lit(FANOUT)))
        own = F.when(F.col("n") > 1, F.array(F.struct(before.alias("before"), after.alias("after")))).otherwise(F.array().cast(STEPS))
        if level is tree[-1]:
            level = level.withColumn("parent", F.col("idx"))
            own = F.array().cast(STEPS)
        else:
            level = with_runs(level)
        up = above.select("group", F.col("idx").alias("parent"), F.col("steps").alias("__up"), *keep)
        kept = [c for c in level.columns if c not in ("parent", "__run", "n")]
        above = level.join(up, ["group", "parent"]).select(*kept, F.concat(own, F.col("__up")).alias("steps"), *keep)
    return above


def fold(node: Column, steps: Column) -> Column:
    """The root that follows from a node and its steps."""
    return F.aggregate(steps, node, lambda x, s: digest(as_text(s["before"]), as_text(x), as_text(s["after"])))


def proof(steps: Column) -> Column:
    """All siblings of a node, level by level, left to right, as text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(as_text(s["before"]), as_text(s["after"]))), "")


def manifest(leaves: DataFrame, group: str, order: str) -> DataFrame:
    """``leaves`` (group, order, leaf, others) with subroot, root (32 bytes each) and steps: a membership proof for every row."""
    others = [c for c in leaves.columns if c != "leaf"]
    # keys that are never null and in the order of the groups, null first: windows and joins on them share a partitioning
    key = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    rows = leaves.select(key.alias("group"), F.struct(*others).alias("__row"), F.col(order).alias("__order"), F.col("leaf").alias("node"))
    tree = levels(ranked(rows, ["group"], ["__order", "node"], "idx").drop("__order"))
    subroots = tree[-1].select(F.lit("").alias("group"), F.col("group").alias("__key"), "node")
    over = levels(ranked(subroots, ["group"], ["__key"], "idx"))
    root = over[-1].select("group", F.col("node").alias("root"), F.array().cast(STEPS).alias("steps"))
    of_group = stage(with_steps(over, root, ["root"]), "merkle-groups")
    top = of_group.select(F.col("__key").alias("group"), F.col("node").alias("subroot"), "root", "steps")
    return with_steps(tree, top, ["subroot", "root"]).select("__row.*", F.col("node").alias("leaf"), "subroot", "root", "steps")


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """source, doc_id, leaf and ``changed``: where ``tampered`` holds, the leaf of the text with A-Z in lower case."""
    fields = {c: F.col(c) for c in FIELDS}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = fields | {"text": F.translate("text", upper, upper.lower())}
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf(lowered))
    return docs.select("source", "doc_id", leaf(fields).alias("leaf"), changed.alias("changed"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by source; each fifth document by the CRC of its id is checked as tampered with.

    A null doc_id is never tampered with.
    """
    leaves = stage(document_leaves(docs, crc32_utf8(F.col("doc_id")) % 5 == 0), "leaves")
    found = manifest(leaves, "source", "doc_id")
    folded = as_text(fold(F.coalesce("changed", "leaf"), F.col("steps")))
    shown = found.select("doc_id", "source", *[as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(proof(F.col("steps")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(depth: int = 8) -> str:
    """The manifest of ``documents`` in DuckDB's SQL, for groups of at most 16 ** depth rows."""
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    leaf_of = lambda text: "sha256(" + " || ".join(enc(text if c == "text" else c) for c in FIELDS) + ")"
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, bottom: str) -> list[str]:
        parts = [f"{name}0 AS ({bottom})"]
        for k in range(depth):
            parts.append(f"{name}{k}r AS (SELECT g, idx // {FANOUT} AS up, list(node ORDER BY idx) AS run, any_value(n) AS n FROM {name}{k} GROUP BY ALL)")
            parts.append(f"{name}{k + 1} AS (SELECT g, up AS idx, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS node, (n + {FANOUT - 1}) // {FANOUT} AS n FROM {name}{k}r)")
        return parts

    def climb(name: str, start: str, rows: str, row: str) -> list[str]:
        parts, held = [], rows
        for k in range(depth):
            at = f"(x.{row} // {FANOUT ** k}) % {FANOUT} + 1"
            mine = f"array_to_string(r.run[1:{at} - 1], '')", f"array_to_string(r.run[{at} + 1:], '')"
            step = f"CASE WHEN r.n > 1 THEN x.proof || {mine[0]} || {mine[1]} ELSE x.proof END AS proof, CASE WHEN r.n > 1 THEN sha256({mine[0]} || x.acc || {mine[1]}) ELSE x.acc END AS acc"
            on = f"x.{start} IS NOT DISTINCT FROM r.g AND x.{row} // {FANOUT ** (k + 1)} = r.up"
            parts.append(f"{name}c{k} AS (SELECT x.* REPLACE ({step.replace(' AS proof, ', ' AS proof, ')}) FROM {held} x JOIN {name}{k}r r ON {on})")
            held = f"{name}c{k}"
        return parts

    ctes = [
        f"lv AS (SELECT doc_id, source, {leaf_of('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf_of(low)} END AS changed FROM documents)",
        "nm AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM lv)",
        *tree("a", "SELECT source AS g, idx, leaf AS node, n FROM nm"),
        f"sb AS (SELECT g AS source, node AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS sidx, count(*) OVER () AS n FROM a{depth})",
        *tree("b", "SELECT 0 AS g, sidx AS idx, subroot AS node, n FROM sb"),
        "x0 AS (SELECT nm.*, subroot, sidx, 0 AS zero, '' AS proof, coalesce(changed, leaf) AS acc FROM nm JOIN sb ON nm.source IS NOT DISTINCT FROM sb.source)",
        *climb("a", "source", "x0", "idx"),
        *climb("b", "zero", f"ac{depth - 1}", "sidx"),
    ]
    return f"WITH {', '.join(ctes)} SELECT doc_id, source, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = node AS verified FROM bc{depth - 1}, (SELECT node FROM b{depth})"
