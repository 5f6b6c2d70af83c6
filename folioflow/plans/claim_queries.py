"""Candidate contradictions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..operators import claims as cl
from ..operators.graph import connected_components
from ..sources.tables import table
from .staging import stage
from . import fixtures as fx
from .registry import query

#: The provided vectors are nearly random: the production window of 0.5 to 0.95 would be empty.
LOWER, UPPER = 0.2, 0.4

_PAIR = "JOIN claims o ON c.project_id = o.project_id AND c.claim_id <> o.claim_id"
_COS = "list_cosine_similarity(c.vector, o.vector)"
_FAR = "AND NOT (c.document_id = o.document_id AND abs(c.seq - o.seq) <= 1)"


def _spec(n: int, where: str, limit: int) -> str:
    rank = f"row_number() OVER (PARTITION BY c.claim_id ORDER BY {_COS} DESC, o.claim_id)"
    return f"SELECT c.claim_id, {n} AS spec, {rank} AS rank, o.claim_id AS other_id, {_COS} AS score FROM claims c {_PAIR} {where} WHERE {_COS} >= {LOWER} QUALIFY {rank} <= {limit}"


NEAR = f"""{fx.CLAIMS}, near AS (SELECT * FROM ({_spec(1, "AND o.priority " + _FAR, 4)} UNION ALL {_spec(2, "AND c.document_id = o.document_id", 1)}
  UNION ALL {_spec(3, "AND c.document_id = o.document_id " + _FAR, 15)}) WHERE score <= {UPPER})"""
BUNDLES = f"""{NEAR}, q AS (SELECT * FROM near WHERE spec < 3 UNION ALL SELECT * FROM near n WHERE spec = 3 AND NOT EXISTS (SELECT 1 FROM near m WHERE m.spec < 3 AND m.claim_id = n.claim_id AND m.other_id = n.other_id)),
  bundles AS (SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY spec, rank) AS pos, other_id FROM q QUALIFY pos <= 10)"""
ONCE = f"""{BUNDLES}, once AS (SELECT claim_id, pos, other_id FROM bundles
  QUALIFY row_number() OVER (PARTITION BY least(claim_id, other_id), greatest(claim_id, other_id) ORDER BY claim_id, pos) = 1)"""


def near(spark, d):
    return cl.neighbours(fx.claims(spark, d), lower=LOWER, upper=UPPER)


@query("j16_neighbours", f"WITH {NEAR} SELECT claim_id, spec, rank::INT AS rank, other_id, round(score, 6) AS score FROM near")
def j16_neighbours(spark, d):
    return near(spark, d).withColumn("score", F.round("score", 6))


@query("t2_quota_merge", f"WITH {BUNDLES} SELECT claim_id, pos::INT AS pos, other_id FROM bundles")
def t2_quota_merge(spark, d):
    return cl.quota_merge(near(spark, d))


@query("w9_candidate_pairs", f"WITH {ONCE} SELECT claim_id, pos::INT AS pos, other_id FROM once")
def w9_candidate_pairs(spark, d):
    """For every claim the at most ten claims that may contradict it, each unordered pair once."""
    return cl.unordered_once(cl.quota_merge(near(spark, d)))


@query("c49_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def c49_cosine(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 9).alias("score"))


@query("f9_rating_threshold", "SELECT doc_id, (doc_id * 37) % 101 AS rating FROM labels WHERE (doc_id * 37) % 101 >= 50")
def f9_rating_threshold(spark, d):
    return table(spark, d, "labels").select("doc_id", (F.col("doc_id") * 37 % 101).alias("rating")).where("rating >= 50")


@query("f10_two_stage_verdict", """SELECT doc_id, CASE WHEN (doc_id * 37) % 101 >= 50 THEN coalesce(CASE WHEN doc_id % 3 > 0 THEN (doc_id * 53) % 101 END >= 50, false) ELSE false END AS verified FROM labels""")
def f10_two_stage_verdict(spark, d):
    v = table(spark, d, "labels").select("doc_id", (F.col("doc_id") * 37 % 101).alias("rating_1"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") * 53 % 101).alias("rating_2"))
    return cl.verified(v).select("doc_id", "verified")


@query("j19_translate_hits", f"""WITH {BUNDLES}, hits AS (SELECT claim_id, unnest([1, 3, 99]) AS i FROM claims) SELECT h.claim_id, i AS index, b.other_id FROM hits h JOIN bundles b ON b.claim_id = h.claim_id AND b.pos = i""")
def j19_translate_hits(spark, d):
    hits = fx.claims(spark, d).select("claim_id", F.explode(F.array(F.lit(1), F.lit(3), F.lit(99))).alias("index"))
    return cl.translate_hits(hits, cl.quota_merge(near(spark, d)))


_PAIRS = f"""{fx.CLAIMS}, n AS (SELECT count(*) AS n FROM claims), pairs AS (SELECT claim_id AS pair, claim_id AS claim_a_id, (claim_id * 7 + 1) % n AS claim_b_id FROM claims, n)"""


def _pairs(spark, d):
    """A pair begins at every claim."""
    c = fx.claims(spark, d).select("claim_id")
    n = c.agg(F.count("*").alias("n"))
    return c.join(F.broadcast(n)).select(F.col("claim_id").alias("pair"), F.col("claim_id").alias("claim_a_id"), ((F.col("claim_id") * 7 + 1) % F.col("n")).alias("claim_b_id"))


def _candidates(spark, d):
    """The best candidate of every claim is its contradiction."""
    first = cl.unordered_once(cl.quota_merge(near(spark, d))).where("pos = 1")
    return first.select(F.col("claim_id").alias("pair"), F.col("claim_id").alias("claim_a_id"), F.col("other_id").alias("claim_b_id"))


@query("j20_pair_payloads", f"""WITH {_PAIRS} SELECT pair, a.document_id AS document_a, b.document_id AS document_b, a.claim_id IS NOT NULL AND b.claim_id IS NOT NULL AS complete
  FROM pairs LEFT JOIN claims a ON a.claim_id = claim_a_id LEFT JOIN claims b ON b.claim_id = claim_b_id""")
def j20_pair_payloads(spark, d):
    return cl.pair_payloads(_pairs(spark, d), fx.claims(spark, d)).select("pair", "document_a", "document_b", "complete")


@query("a14_clusters")
def a14_clusters(spark, d):
    """All claims of the pairs are compared, whatever their documents.

    A recursive SQL would be too slow, so the tests hold it against brute force.
    """
    claims, pairs = fx.claims(spark, d), stage(_candidates(spark, d), "pairs")
    held = pairs.select(F.explode(F.array("claim_a_id", "claim_b_id")).alias("claim_id")).distinct()
    similar = cl.similar_claims(claims.join(held, "claim_id"))
    found = connected_components(cl.pair_edges(pairs, similar))
    return cl.clusters(pairs, found).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("a15_local_numbers", """WITH e AS (SELECT o_custkey % 10 AS cluster, o_orderkey AS ord, o_custkey % 37 AS a, o_orderkey % 41 AS b FROM orders),
  s AS (SELECT cluster, unnest([a, b]) AS node, ord * 2 + unnest([0, 1]) AS k FROM e), f AS (SELECT cluster, node, min(k) AS k FROM s GROUP BY cluster, node)
  SELECT cluster, node, (row_number() OVER (PARTITION BY cluster ORDER BY k))::INT AS number FROM f""")
def a15_local_numbers(spark, d):
    o = table(spark, d, "orders")
    edges = o.select((F.col("o_custkey") % 10).alias("cluster"), F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % 37).alias("a"), (F.col("o_orderkey") % 41).alias("b"))
    return cl.local_numbers(edges)


@query("j17_neighbour_window", f"""WITH {fx.CHUNKS} SELECT chunk_id, array_to_string(list(chunk_id) OVER (PARTITION BY document_id ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), ',') AS previous,
  array_to_string(list(chunk_id) OVER (PARTITION BY document_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), ',') AS following FROM chunks""")
def j17_neighbour_window(spark, d):
    out = cl.neighbour_window(fx.chunks(spark, d))
    return out.select("chunk_id", *[F.nullif(F.array_join(c, ","), F.lit("")).alias(c) for c in ("previous", "following")])


_SAID = r"""s AS (SELECT *, CASE WHEN chunk_type = 'text' THEN regexp_replace(text, '^\s+|\s+$', '', 'g') WHEN seq % 3 = 0 THEN ''
  ELSE '[SUMMARY]' || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || '[/SUMMARY]' END AS said FROM chunks)"""


@query("w8_context", f"""WITH {fx.CHUNKS}, {_SAID}, w AS (SELECT *, list({{'p': toc_path, 't': said}}) OVER (PARTITION BY document_id ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS b,
    list({{'p': toc_path, 't': said}}) OVER (PARTITION BY document_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS a FROM s),
  t AS (SELECT chunk_id, coalesce(array_to_string(list_transform(list_filter(b, lambda x: x.p = toc_path), lambda x: x.t), chr(10)), '') AS prefix,
    coalesce(array_to_string(list_transform(list_filter(a, lambda x: x.p = toc_path), lambda x: x.t), chr(10)), '') AS suffix FROM w)
  SELECT chunk_id, CASE WHEN length(prefix) > 900 THEN left(prefix, 180) || chr(10) || '...[TRUNCATED]...' || chr(10) || right(prefix, 720) ELSE prefix END AS prefix, left(suffix, 500) AS suffix FROM t""")
def w8_context(spark, d):
    chunks = fx.chunks(spark, d).withColumn("summary", F.when(F.col("seq") % 3 > 0, F.col("text")))
    return cl.context_text(chunks, most_before=900).select("chunk_id", "prefix", "suffix")
