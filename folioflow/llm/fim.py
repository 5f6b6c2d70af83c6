"""Fill-in-middle: texts cut at token borders by rank and select on packed bit vectors.

A bit for each UTF-8 byte says whether a token (``[A-Za-z]+|[^A-Za-z]``) begins there.  The bits are packed, eight to a
byte, block by block, and a directory holds the number of set bits before each block of 512: the total popcount is the
number of tokens n, and ``select`` of a token's rank finds its block in the directory, then its byte.  Memory for a text
is its bytes and an eighth of them; nothing is made for each token.

Python returns three numbers a text; texts are cut, put together and hashed in Spark.

Cases: a null text is empty and plain.  A null id is hashed as the empty string.  Rows that repeat are transformed
alike.  Texts of any length are cut whole.  Extra columns stay; the columns that are added replace those of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import limit_batches, release, value_of

#: The marks, and the shares in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes whose borders are computed at once, and bits of a block of the directory.
STRETCH, BLOCK = 1 << 20, 512


class Borders:
    """Rank directory over the token borders of one UTF-8 text."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        packed, before = [], False
        for at in range(0, len(data), STRETCH):
            part = data[at : at + STRETCH]
            letter = ((part | 0x20) >= 97) & ((part | 0x20) <= 122)
            follows = np.empty(len(part), bool)
            follows[0] = before
            follows[1:] = letter[:-1]
            packed.append(np.packbits(((part & 0xC0) != 0x80) & ~(letter & follows), bitorder="little"))
            before = bool(letter[-1])
        bits = np.concatenate(packed) if packed else np.empty(0, np.uint8)
        self.bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        counts = np.bitwise_count(self.bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def select(self, rank: int) -> int:
        """The byte where token ``rank`` begins; the text's end for the rank after the last."""
        if rank >= self.total:
            return self.size
        block = int(np.searchsorted(self.before, rank, "right")) - 1
        inside = np.unpackbits(self.bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(inside)[rank - int(self.before[block])])


def cut(data: bytes | memoryview, h1: int, h2: int) -> tuple[int, int, int]:
    """Number of tokens, bytes of the prefix, bytes of prefix and middle."""
    borders = Borders(np.frombuffer(data, np.uint8))
    low, high = sorted((h1 % (borders.total + 1), h2 % (borders.total + 1)))
    return borders.total, borders.select(low), borders.select(high)


CUTS = T.StructType().add("n", "long").add("low", "long").add("high", "long")


@F.arrow_udf(CUTS)
def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """:func:`cut` of texts (as binary) with two hashes each."""
    try:
        for texts, h1, h2 in batches:
            rows = [cut(t.as_buffer(), a, b) for t, a, b in zip(texts, h1.to_pylist(), h2.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], ["n", "low", "high"])
    finally:
        release()


def hashes(doc_id: Column, seed: str = "1:") -> Column:
    """Four unsigned 32-bit numbers from an id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return value_of(digest, lambda d: F.array(*[F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]))


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = "1:") -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output: its text with the middle moved to the end.

    psm: prefix, suffix, middle; spm: suffix, prefix, middle; plain: the text, where it is empty, holds a mark, or by chance.
    """
    limit_batches(docs.sparkSession)
    rows = docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__h", hashes(F.col(doc_id), seed))
    h = [F.get("__h", F.lit(i)) for i in range(4)]
    rows = rows.withColumn("__cut", cuts(F.encode("__text", "UTF-8"), h[0], h[1]))
    marked = F.col("__text").contains(PREFIX) | F.col("__text").contains(SUFFIX) | F.col("__text").contains(MIDDLE)
    plain = (F.col("__text") == "") | marked | (h[2] % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm")
    rows = rows.withColumn("n", F.col("__cut.n")).withColumn("form", form)
    low, high, data = F.col("__cut.low").cast("int"), F.col("__cut.high").cast("int"), F.encode("__text", "UTF-8")
    piece = lambda at, length: F.decode(F.substring(data, at + 1, length), "UTF-8")
    parts = F.struct(piece(F.lit(0), low).alias("p"), piece(low, high - low).alias("m"), piece(high, F.octet_length("__text") - high).alias("s"))
    rows = rows.withColumn("__parts", F.when(F.col("form") != "plain", parts))
    p, m, s = (F.col(f"__parts.{x}") for x in "pms")
    psm = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)
    spm = F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("__text"))
    rows = rows.withColumn("prefix_chars", F.length(p).cast("long")).withColumn("middle_chars", F.length(m).cast("long"))
    return rows.withColumn("output", output).drop("__text", "__h", "__cut", "__parts")


def restore(output: Column, form: Column) -> Column:
    """The text, from a transformed one and its form; marks cannot stand inside the parts of one that was cut."""
    whole = lambda x: F.when(form == "psm", F.concat(x[1], x[3], x[2])).otherwise(F.concat(x[2], x[3], x[1]))
    return F.when(form == "plain", output).otherwise(value_of(F.split(output, "<[PSM]>", -1), whole))


def digest(transformed: DataFrame) -> DataFrame:
    hashed = transformed.withColumn("output_sha256", F.sha2("output", 256)).withColumn("restored_sha256", F.sha2(restore(F.col("output"), F.col("form")), 256))
    return hashed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, len(u) AS n, [('0x' || substr(h, 1, 8))::BIGINT, ('0x' || substr(h, 9, 8))::BIGINT, ('0x' || substr(h, 17, 8))::BIGINT, ('0x' || substr(h, 25, 8))::BIGINT] AS g FROM t),
c AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
