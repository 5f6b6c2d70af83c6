"""Secret scans by corpus-wide ownership frequency; DataFrame functions only.

Base spans are the matches of three fixed kinds.  The method looks at every candidate value of the corpus
(base values and long mixed tokens), counts the distinct repositories and owners that hold its hash, and so
tells widely copied examples from owner-specific, live-looking credentials.  A value in more than
``max_owners`` owners or more than ``max_repositories`` repositories is an example.  Live-looking tokens become
spans of kind ``token``; base spans always stay and are marked as example or live.  A token may hold slashes
if it mixes cases and digits and has no part that is a lower-case word, as paths and addresses have.

A span is ``kind:start:end`` over the whole match, in code points, end exclusive.

Cases: a null text is an empty one.  Rows with a null owner or repository count as one owner or repository
of their own.  Repeated rows (same id, same text) get the same result each and count once.  A null ``doc_id``
is a key like any other.  Extra columns are kept by :func:`redact_secrets`; names that start with ``__ff_``
are reserved.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, stage, value_of

#: The base kinds in the order in which they sort, then the method's own (with and without
#: slashes).  The quantifiers of access and hex hold the least length: a run that is too short has no longer match inside it.
KINDS = ["assign", "access", "hex", "token", "token"]
BASE_KINDS = 3
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
SLASHED = r"[A-Za-z0-9+/_=-]{20,}"
TOKEN = r"[A-Za-z0-9+_=-]{20,}"
ASSIGN_VALUE = 12
PLACEHOLDER = "[SECRET]"
#: What a token must hold, and what one with slashes must and must not.
TOKEN_HAS = ["[0-9].*[0-9].*[0-9]", "[A-Za-z].*[A-Za-z]"]
SLASHED_HAS = [*TOKEN_HAS, "[A-Za-z0-9]/[A-Za-z0-9]", "[A-Z].*[A-Z].*[A-Z]", "[a-z].*[a-z].*[a-z]"]
SLASHED_LACKS = "//|^/|(?:^|/)[a-z_-]{3,}(?:/|$)"

SPAN = "array<struct<start:int,rank:int,end:int,hash:string>>"
#: A fold copies its state at every step, so sums run over parts of so many items.
PART = 100
#: Texts are cut into blocks of so many characters, so that a piece is found without a walk from the text's start.
BLOCK = 1024


def _running(numbers: Column) -> Column:
    """Sum of the numbers before each one, and of all as ``at``."""
    return F.aggregate(
        numbers,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["before"], F.array(a["at"])).alias("before")),
    )


def _positions(hits: Column, gaps: Column) -> Column:
    """Start of each hit, from the lengths of what stands between them."""
    gap = F.transform(F.slice(gaps, 1, F.size(hits)), F.length)
    both = F.flatten(F.zip_with(gap, F.transform(hits, F.length), lambda g, h: F.array(g, h)))

    def starts(lengths: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / PART).cast("int")), lambda i: _running(F.slice(lengths, i * PART + 1, F.lit(PART))))
        whole = lambda p: F.zip_with(p, _running(F.transform(p, lambda x: x["at"]))["before"], lambda x, o: F.transform(x["before"], lambda y: y + o))
        return F.filter(F.flatten(value_of(parts, whole)), lambda _, i: i % 2 == 1)

    return value_of(both, starts)


def _matches(text: Column, pattern: str, rank: int, maybe: Column, value_group: int = 0) -> Column:
    """All matches of a kind as spans; ``maybe`` is a cheap test that every text with a match passes."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else hits
    starts = _positions(hits, F.split(text, pattern, -1))
    rows = F.arrays_zip(starts.alias("start"), hits.alias("hit"), values.alias("value"))
    spans = F.transform(
        rows,
        lambda r: F.struct(
            r["start"].alias("start"),
            F.lit(rank).alias("rank"),
            (r["start"] + F.length(r["hit"])).alias("end"),
            r["value"].alias("value"),
        ),
    )
    if value_group:
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= ASSIGN_VALUE)
    has = SLASHED_HAS if pattern == SLASHED else TOKEN_HAS if pattern == TOKEN else []
    if has:
        passes = lambda v: functools.reduce(lambda a, b: a & b, [v.rlike(x) for x in has])
        spans = F.filter(spans, lambda s: passes(s["value"]))
    if pattern == SLASHED:
        spans = F.filter(spans, lambda s: ~s["value"].rlike(SLASHED_LACKS))
    hashed = F.transform(
        spans, lambda s: F.struct(s["start"], s["rank"], s["end"], F.sha2(s["value"].cast("binary"), 256).alias("hash"))
    ).cast(SPAN)
    return F.when(maybe & text.rlike(pattern), hashed).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Base spans of a text, sorted by start, then kind."""
    assign = _matches(text, ASSIGN, 0, text.contains("=") | text.contains(":"), 2)
    access = _matches(text, ACCESS, 1, text.contains("AKIA"))
    hexes = _matches(text, HEX, 2, F.lit(True))
    return F.array_sort(F.concat(assign, access, hexes))


def join_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def find_candidates(docs: DataFrame, owner: Column, repository: Column, *keep: str) -> DataFrame:
    """Per row: doc_id, key (binary MD5 of the text), owner, repository, base spans and tokens; ``keep`` under names of its own.

    Tokens are those with slashes and those without; some may overlap others or base spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.col(c).alias(f"__ff_{c}") for c in keep]
    read = docs.select("doc_id", text.alias("text"), owner.alias("owner"), repository.alias("repository"), *kept)
    read = read.withColumn("base", base_spans(F.col("text"))).withColumn("key", F.unhex(F.md5("text")))
    slashed = _matches(F.col("text"), SLASHED, 3, F.col("text").contains("/"))
    return read.withColumn("tokens", F.concat(slashed, _matches(F.col("text"), TOKEN, 4, F.lit(True)))).drop("text")


def text_spans(found: DataFrame) -> DataFrame:
    """key, start, rank, end, hash of every text's base spans and of those tokens that nothing of a kind before theirs overlaps."""
    spans = found.select("key", F.explode(F.concat("base", "tokens")).alias("s")).distinct().select("key", "s.*")
    # what follows is what precedes in falling order: a frame that ends with the group would be read anew for every row
    order = [F.col(c) for c in ("start", "rank", "end")]
    before, after = (Window.partitionBy("key").orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (order, [c.desc() for c in order]))
    spans = spans.withColumn("holds", F.col("rank") < BASE_KINDS)
    for rank in (3, 4):
        reach, following = F.max(F.when(F.col("holds"), F.col("end"))).over(before), F.min(F.when(F.col("holds"), F.col("start"))).over(after)
        spans = spans.withColumn("reach", reach).withColumn("following", following)
        free = (F.coalesce("reach", "start") <= F.col("start")) & (F.coalesce("following", "end") >= F.col("end"))
        spans = spans.withColumn("holds", F.col("holds") | ((F.col("rank") == rank) & free))
    return spans.where("holds").drop("holds", "reach", "following")


def ownership(found: DataFrame, spans: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories over all rows; summed before every shuffle, so a hot value is no hot task."""
    holders = found.where(F.size("base") + F.size("tokens") > 0).select("key", "owner", "repository").distinct()
    seen = spans.select("key", "hash").distinct().join(holders, "key")
    by_owner = seen.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("hash", "owner")
    return (
        by_owner.agg(F.count("*").alias("repositories"))
        .groupBy("hash")
        .agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))
    )


def judged(found: DataFrame, max_owners: int, max_repositories: int, salts: int = 16) -> DataFrame:
    """key, start, rank, end, hash, live of every text's base spans and live tokens.

    The values of examples are few and each in many texts: they are broadcast, or, where there are too many,
    joined in ``salts`` parts each.  All other values are live.
    """
    spans = stage(text_spans(found), "spans")
    examples = ownership(found, spans).where((F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories))
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    known = bounded(stage(examples.select("hash", parts, F.lit(True).alias("example")), "examples"))
    salted = spans.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    told = salted.join(known, ["hash", "salt"], "left").withColumn("live", F.col("example").isNull())
    return told.where((F.col("rank") < BASE_KINDS) | F.col("live")).select("key", "start", "rank", "end", "hash", "live")


def scan(docs: DataFrame, owner: Column, repository: Column, *, max_owners: int = 2, max_repositories: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and all spans as arrays, n_live, n_example."""
    found = stage(find_candidates(docs, owner, repository), "candidates")
    told = judged(found, max_owners, max_repositories).groupBy(F.col("key").alias("__ff_key"))
    told = told.agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end", "hash"))).alias("spans"),
        F.count_if(F.col("live")).alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )
    empty = F.size("base") + F.size("tokens") == 0
    none = [F.array().cast(SPAN).alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example")]
    full = found.where(~empty).join(told, F.col("key") == F.col("__ff_key"), "left")
    full = full.select("doc_id", "base", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))
    return found.where(empty).select("doc_id", "base", *none).unionByName(full)


def digest(scanned: DataFrame) -> DataFrame:
    """The counts and digests of a scan's spans."""
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(join_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        join_spans(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
    )


def replaced(text: Column, runs: Column) -> Column:
    """``text`` with each of ``runs`` (start, end; sorted, apart from each other) replaced by a placeholder."""

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        inner = F.substring(F.get(blocks, first), start % BLOCK + 1, end - start)
        tail = F.coalesce(F.substring(F.get(blocks, last), F.lit(1), end % BLOCK), F.lit(""))
        middle = F.array_join(F.slice(blocks, first + 2, last - first - 1), "")
        cut = F.when(first == last, inner).otherwise(F.concat(F.substring(F.get(blocks, first), start % BLOCK + 1, F.lit(BLOCK)), middle, tail))
        return F.when(start < end, cut).otherwise("")

    def whole(blocks: Column) -> Column:
        begin = lambda i: F.coalesce(F.get(runs, i - 1)["end"], F.lit(0))
        end = lambda i: F.coalesce(F.get(runs, i)["start"], F.length(text))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda i: piece(blocks, begin(i), end(i))), PLACEHOLDER)

    return value_of(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)), whole)


def redact_secrets(docs: DataFrame, owner: Column, repository: Column, *, max_owners: int = 2, max_repositories: int = 3) -> DataFrame:
    """``docs`` with base spans and live-looking tokens replaced; all columns stay, ``n_chars`` follows the text.

    Rows are written once with their candidates, so texts are searched once; only texts that hold a candidate
    are joined, the others never move.  Overlapping spans share one placeholder.
    """
    found = stage(find_candidates(docs, owner, repository, *docs.columns), "candidates")
    inside = Window.partitionBy("key").orderBy("start", "rank", "end")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    spans = judged(found, max_owners, max_repositories).withColumn("fresh", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int"))
    runs = spans.withColumn("run", F.sum("fresh").over(inside)).groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy(F.col("key").alias("__ff__key")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__ff__runs"))
    rows = found.withColumn("__ff__any", F.size("base") + F.size("tokens") > 0)
    joined = rows.where("__ff__any").join(runs, F.col("key") == F.col("__ff__key"), "left")
    hit, old = F.col("__ff__runs").isNotNull(), F.col("__ff_text")
    joined = joined.withColumn("__ff_text", F.when(hit, replaced(old, F.col("__ff__runs"))).otherwise(old))
    if "n_chars" in docs.columns:
        length = F.length("__ff_text").cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("__ff_n_chars", F.when(hit, length).otherwise(F.col("__ff_n_chars")))
    named = [F.col(f"__ff_{c}").alias(c) for c in docs.columns]
    return rows.where("not __ff__any").select(*named).unionByName(joined.select(*named))
