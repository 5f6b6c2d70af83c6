"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, compared by subtracting and peeling.

Paragraphs are the distinct lines of a text that hold a word; a paragraph's key is 60 bits of its MD5.  A sketch has
three tables of ``WIDTH`` cells; a key goes to one cell of each, and a cell holds the number of its keys, their
exclusive or, and the exclusive or of their check numbers.  The cells of two versions are subtracted one by one; a cell
with one key left and a matching check number gives that key away, which is taken out of its other cells, until none is
left.  What does not peel is tried again in four times as many cells: the keys are dealt by two further bits into four
sketches of the same size, each peeled by itself, and only those that fail are dealt again.  So a row stays small, the
work is linear in the paragraphs, and a long document spreads over rows.  The recovered keys are the exact difference
(but for collisions of 60 bits), whatever the number of paragraphs.

All of it is column functions; no Python runs in tasks.

Cases: a null text is empty and has a sketch of empty cells; two empty texts are alike (1.0).  Equal texts have equal
sketches; so have texts with the same paragraphs in another order or number.  Rows that are equal in doc_id and text
are one document and share their results; other rows of one doc_id follow each other by the MD5 of id and text.  A null
doc_id comes first.  A single document is its own successor.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, stage, value_of

#: Cells of each of the three tables, bits of a cell's number, rounds of peeling before a sketch counts as failed.
WIDTH, BITS, ROUNDS = 16, 4, 16
TABLES = 3
#: Bits of a key below those that deal it into finer sketches, and bits for each try.
PLACED, DEALT = BITS * TABLES, 2
KEY_BITS = 60

CELL = "struct<n:int,k:bigint,c:bigint>"


def paragraph_keys(text: Column) -> Column:
    """The distinct 60-bit keys of a text's paragraphs."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.array_distinct(F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")))


def check(key: Column) -> Column:
    """A number that tells whether a cell's key is one key or several of them mixed."""
    return (key % 2147483647 * 48271) % 2147483647


def place(key: Column, table: Column) -> Column:
    """The cell of a key in a table, 0 to WIDTH - 1."""
    return F.call_function("shiftright", key, table * BITS).bitwiseAND(WIDTH - 1)


def _mixed(keys: Column, f=lambda x: x) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(f(x)))


def sketch(keys: Column) -> Column:
    """The cells of the three tables, one after the other."""

    def cell(i: Column) -> Column:
        inside = F.filter(keys, lambda x: place(x, F.floor(i / WIDTH).cast("int")) == i % WIDTH)
        return value_of(inside, lambda ks: F.struct(F.size(ks).alias("n"), _mixed(ks).alias("k"), _mixed(ks, check).alias("c")))

    return F.transform(F.sequence(F.lit(0), F.lit(WIDTH * TABLES - 1)), cell)


def serialized(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["n"], c["k"], c["c"])), ",")


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.struct((a["n"] - b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["c"].bitwiseXOR(b["c"]).alias("c")))


def peel(cells: Column) -> Column:
    """``left`` and ``right`` (keys of one version only) of subtracted cells; null if some cells do not peel.

    A round takes out all keys that stand alone in a cell.  ``n`` of a key is 1 (left) or -1 (right).
    """
    empty = F.array().cast("array<struct<n:int,k:bigint>>")
    state = f"struct<cells:array<{CELL}>,found:array<struct<n:int,k:bigint>>,open:boolean>"

    def step(s: Column, _: Column) -> Column:
        alone = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == check(c["k"])) & (c["k"] >= 0))
        keys = F.array_distinct(F.transform(alone, lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"))))

        def without(c: Column, i: Column, gone: Column) -> Column:
            mine = F.filter(gone, lambda g: place(g["k"], F.floor(i / WIDTH).cast("int")) == i % WIDTH)
            out = lambda a, g: F.struct((a["n"] - g["n"]).alias("n"), a["k"].bitwiseXOR(g["k"]).alias("k"), a["c"].bitwiseXOR(check(g["k"])).alias("c"))
            return F.aggregate(mine, c, out)

        def after(gone: Column) -> Column:
            cells_left = F.transform(s["cells"], lambda c, i: without(c, i, gone))
            return F.struct(cells_left.alias("cells"), F.concat(s["found"], gone).alias("found"), (F.size(gone) > 0).alias("open")).cast(state)

        return F.when(s["open"], value_of(keys, after)).otherwise(s)

    start = F.struct(cells.alias("cells"), empty.alias("found"), F.lit(True).alias("open")).cast(state)
    ended = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)

    def result(s: Column) -> Column:
        clean = F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0))
        side = lambda n: F.transform(F.filter(s["found"], lambda g: g["n"] == n), lambda g: g["k"])
        return F.when(clean, F.struct(side(1).alias("left"), side(-1).alias("right")))

    return value_of(ended, result)


def _tried(rows: DataFrame) -> DataFrame:
    """``rows`` with left and right as recovered; the keys of both versions stay only where the sketches did not peel."""
    rows = rows.withColumn("__got", peel(subtract(sketch(F.col("a")), sketch(F.col("b")))))
    failed = F.col("__got").isNull()
    kept = [F.when(failed, F.col(c)).alias(c) for c in ("a", "b")]
    others = [c for c in rows.columns if c not in ("a", "b", "__got")]
    return rows.select(*others, *kept, F.col("__got.left").alias("left"), F.col("__got.right").alias("right"))


def differences(pairs: DataFrame) -> DataFrame:
    """``pairs`` (others, a, b: keys of two versions) as rows with ``left`` and ``right``, the keys that only one version has.

    A pair has one row if its first sketches peel, else one for each finer sketch: gather them by the pair's columns.
    """
    others = [c for c in pairs.columns if c not in ("a", "b")]
    tried = stage(_tried(pairs), "peeled")
    done = tried.where("left is not null").drop("a", "b")
    bits = PLACED
    failed = tried.where("left is null")
    while failed.take(1):
        if bits > KEY_BITS - DEALT:
            raise ValueError("sketches do not peel: more paragraphs share 60 bits than cells can tell apart")
        part = lambda c, i: F.filter(c, lambda x: F.call_function("shiftright", x, F.lit(bits)).bitwiseAND((1 << DEALT) - 1) == i)  # noqa: E731, B023
        dealt = failed.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit((1 << DEALT) - 1))))
        finer = dealt.select(*others, part(F.col("a"), F.col("__i")).alias("a"), part(F.col("b"), F.col("__i")).alias("b"))
        tried = stage(_tried(finer.where((F.size("a") > 0) | (F.size("b") > 0))), "peeled")
        done = done.unionByName(tried.where("left is not null").drop("a", "b"))
        failed = tried.where("left is null")
        bits += DEALT
    return done


def likeness(n_a: Column, n_b: Column, n_different: Column) -> Column:
    """Shared paragraphs out of all, 1 for two empty versions."""
    return F.when(n_a + n_b == 0, 1.0).otherwise((n_a + n_b - n_different) / (n_a + n_b + n_different))


def _named(docs: DataFrame) -> DataFrame:
    """__key (of doc_id and text), doc_id, text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text)))
    return docs.select(key.alias("__key"), "doc_id", text.alias("text"))


def successors(named: DataFrame) -> DataFrame:
    """For every document: __key, doc_id, __copies, __n (code points); of the one before it __before and __wants, the characters it takes over."""
    rows = named.groupBy("__key").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("__copies"), F.max(F.length("text")).alias("__n"))
    rows = stage(ranked(rows.withColumn("__all", F.lit(0)), ["__all"], ["doc_id", "__key"], "__place").drop("__all"), "successors")
    total = rows.count()
    before = rows.select((F.col("__place") + 1).alias("__place"), F.col("__key").alias("__before"), F.floor(F.col("__n") / 2).cast("int").alias("__wants"))
    # the first follows the last
    before = before.withColumn("__place", F.when(F.col("__place") == total, 0).otherwise(F.col("__place")))
    return rows.join(before, "__place").drop("__place")


def versions(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, copies, n_chars, edited_sha256, and the paragraph keys ``own``, ``edited``, ``next``.

    Texts are shuffled once, by their key; the beginning that a document lends to the one before it travels to that one.
    """
    named = _named(docs)
    after = stage(successors(named), "after")
    texts = named.select("__key", "text").dropDuplicates(["__key"])
    lent = texts.join(after.select("__key", "__before", "__wants"), "__key")
    lent = lent.select(F.col("__before").alias("__key"), F.left("text", F.col("__wants")).alias("__lent"), paragraph_keys(F.col("text")).alias("next"))
    rows = texts.join(after.select("__key", "doc_id", "__copies", "__n"), "__key").join(lent, "__key")
    half = F.floor(F.col("__n") / 2).cast("int")
    rows = rows.withColumn("__edited", F.concat(F.left("text", F.col("__n") - half), F.col("__lent")))
    return rows.select(
        "__key", "doc_id", "__copies", F.col("__n").cast("long").alias("n_chars"), F.sha2("__edited", 256).alias("edited_sha256"),
        paragraph_keys(F.col("text")).alias("own"), paragraph_keys(F.col("__edited")).alias("edited"), "next",
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for every row of ``docs``: its fingerprint, that of its edited text, and how like it is to that text's and to the next document's.

    A fingerprint is the SHA-256 of the sketch's cells; likeness is found from the sketches themselves.
    """
    found = stage(versions(docs), "versions")
    pairs = found.select("__key", F.explode(F.array(F.struct(F.lit("edited").alias("kind"), F.col("edited").alias("b")), F.struct(F.lit("next").alias("kind"), F.col("next").alias("b")))).alias("p"), F.col("own").alias("a"))
    apart = differences(pairs.select("__key", "p.kind", "a", "p.b"))
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, F.size("left") + F.size("right")).otherwise(0))
    apart = apart.groupBy("__key").agg(count("edited").alias("__edited"), count("next").alias("__next"))
    rows = found.join(apart, "__key").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    own = F.size("own")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        F.sha2(serialized(sketch(F.col("own"))), 256).alias("fingerprint"),
        F.sha2(serialized(sketch(F.col("edited"))), 256).alias("edited_fingerprint"),
        likeness(own, F.size("edited"), F.col("__edited")).alias("near_edited"),
        likeness(own, F.size("next"), F.col("__next")).alias("near_next"),
    )


def oracle_sql() -> str:
    """The same in DuckDB's SQL; likeness by plain sets of paragraph keys."""
    keys = lambda t: f"list_distinct(list_transform(list_filter(string_split({t}, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')), lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT))"
    xor_of = lambda f: f"list_reduce(list_prepend(0::BIGINT, list_transform(ks, lambda x: {f})), lambda a, b: xor(a, b))"

    def printed(keys: str) -> str:
        cell = f"list_transform([list_filter({keys}, lambda x: (x >> ({BITS} * (i // {WIDTH}))) & {WIDTH - 1} = i % {WIDTH})], lambda ks: len(ks) || ':' || {xor_of('x')} || ':' || {xor_of('(x % 2147483647 * 48271) % 2147483647')})[1]"
        return f"sha256(array_to_string(list_transform(range(0, {WIDTH * TABLES}), lambda i: {cell}), ','))"

    like = lambda b: f"CASE WHEN len(a) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, {b}))::DOUBLE / len(list_distinct(list_concat(a, {b}))) END"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n FROM documents),
s AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id)) AS nxt FROM t),
e AS (SELECT *, substr(text, 1, n - n // 2) || substr(nxt, 1, n // 2) AS ed FROM s),
k AS (SELECT doc_id, n, sha256(ed) AS edited_sha256, {keys('text')} AS a, {keys('ed')} AS b, {keys('nxt')} AS c FROM e)
SELECT doc_id, n AS n_chars, edited_sha256, {printed('a')} AS fingerprint, {printed('b')} AS edited_fingerprint, {like('b')} AS near_edited, {like('c')} AS near_next FROM k
"""
