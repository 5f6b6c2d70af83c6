"""Packing token ids into sequences by minimum bin slack.

A document becomes the ids of its text and one end id.  Windows of full capacity are sequences of their own;
what remains of each document is packed: a window starts with the longest remaining piece, and a subset-sum
over bit sets picks the multiset of remaining lengths that fills it closest to capacity; the picked counts
are read back from the bit sets of the single steps.  Groups of pieces are packed independently, one after
the other in a task that streams full windows and holds only the ends of a group's documents.  Equal rows are
told apart by how often a task has met them, so they spread over all groups.

Sequences are padded to the capacity, except that a sequence whose length is a power of two stays as it is.

Cases: a null text is an empty one and has the end id alone.  Repeated rows are packed like others.  A null
``doc_id`` is kept.  Extra columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, runs

CAPACITY = 4096
END_ID = 2
#: The structure of tokenizers that the quick path is exact for, with the same split of
#: lower-case plain text as a pattern for ``re``, and the characters for which case mapping and normalization are those of the library.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTER = "a-z\\xdf-\\xf6\\xf8-\\u012f\\u0132-\\u017f"
_UNITS = re.compile(rf"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s0-9{_LETTER}]+")
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7e\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\u012f\u0132-\u017f\u2010-\u2027\u2030-\u205e\u20ac]*")


@functools.lru_cache(maxsize=2)
def _load(path: str) -> tuple:
    """The tokenizer, one for single units (None where the quick path is not exact), end-of-word flags, special tokens."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    whole = Tokenizer.from_file(path)
    made = json.loads(whole.to_str())
    marks = [t["content"] for t in made["added_tokens"]]
    split = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    suffix = made["model"].get("end_of_word_suffix")
    known = (made["normalizer"] or {}).get("normalizers") == _NORMALIZER and split.get("pattern") == {"Regex": _SPLIT}
    if not (suffix and known and made["post_processor"] is None):
        return whole, None, None, marks
    units = Tokenizer.from_file(path)
    units.normalizer = normalizers.Sequence([])
    units.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    vocabulary = whole.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        last[i] = token.endswith(suffix)
    return whole, units, last, marks


class WordEncoder:
    """Ids of texts, as little-endian 32-bit integers, by a tokenizer file of the ``tokenizers`` library.

    For tokenizers that lower-case and split into runs of letters, digits and the rest, plain texts are split
    here and each distinct unit is encoded once and remembered; other texts, and all texts for other
    tokenizers, are encoded whole.  Units are remembered in two generations of ``most`` each.
    """

    def __init__(self, path: str, most: int = 200_000):
        self.whole, self.units, self.last, self.marks = _load(path)
        self.quick = self.units is not None
        self.most = most
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, text: str) -> bool:
        return self.quick and _PLAIN.fullmatch(text) is not None and not any(m in text for m in self.marks)

    def _learn(self, units: set[str]) -> None:
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        known, old, new = self.known, self.old, []
        for u in units.difference(known):
            found = old.get(u)
            if found is None:
                new.append(u)
            else:
                known[u] = found
        for at in range(0, len(new), 2_000):
            part = new[at : at + 2_000]
            ids = np.array(self.units.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("a unit of the tokenizer does not end with its end-of-word token")
            raw, start = ids.tobytes(), 0
            for u, end in zip(part, (4 * ends).tolist(), strict=True):
                known[u] = raw[start:end]
                start = end

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        for at in range(0, len(texts), 128):
            block = [t or "" for t in texts[at : at + 128]]
            split = [_UNITS.findall(t.lower()) if self._plain(t) else None for t in block]
            if self.quick:
                self._learn(set().union(*[s for s in split if s]))
            known = self.known
            for text, units in zip(block, split, strict=True):
                if units is None:
                    yield np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    yield b"".join(map(known.__getitem__, units))


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian 32-bit), doc_tokens, repeat: full windows, then the rest.

    ``repeat`` counts the rows of the same id and ids that the task met before: equal rows get 0, 1, 2, … in whatever order.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(tokenizer)
        end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        met: Counter[tuple[int, int]] = Counter()
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                row, start, ids, total, repeat = [], [], [], [], []
                doc = batch.column(0).to_pylist()
                for i, raw in enumerate(encode(batch.column(1).to_pylist())):
                    raw += end
                    same = (hash(doc[i]), zlib.crc32(raw))
                    met[same] += 1
                    for a in range(0, len(raw), width):
                        row.append(i)
                        start.append(a // 4)
                        ids.append(raw[a : a + width])
                        total.append(len(raw) // 4)
                        repeat.append(met[same] - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int32())),
                        pa.array(start, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(total, pa.int64()),
                        pa.array(repeat, pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "repeat"],
                )

    return map_arrow(docs.select("doc_id", F.col("text").alias("__text")), run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, repeat long")


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is closest to ``room`` and not above it.

    Bit k of a bit set says that sum k can be reached; counts are split into powers of two.  Lengths join
    from long to short until ``room`` itself is reached.
    """
    mask = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    reached = 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, some = min(counts[length], room // length), 1
        while left > 0:
            take = min(some, left)
            steps.append((length, take, reached))
            reached |= (reached << (length * take)) & mask
            left -= take
            some *= 2
        if reached >> room:
            break
    at, picked = reached.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if at and not before >> at & 1:
            picked[length] = picked.get(length, 0) + take
            at -= length * take
    return picked


def bins(lengths: list[int], capacity: int) -> Iterator[list[int]]:
    """Windows as lists of lengths, each seeded with the longest that is left."""
    counts: dict[int, int] = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    while counts:
        seed = max(counts)
        picked = {seed: 1}
        _take(counts, seed, 1)
        for n, k in fill(counts, capacity - seed).items() if seed < capacity else ():
            picked[n] = picked.get(n, 0) + k
            _take(counts, n, k)
        yield [n for n, k in sorted(picked.items(), reverse=True) for _ in range(k)]


def _take(counts: dict[int, int], n: int, k: int) -> None:
    counts[n] -= k
    if not counts[n]:
        del counts[n]


def pack(cut: DataFrame, *, capacity: int = CAPACITY, groups: int = 1, partition_groups: int = 4, most_partitions: int = 20_000) -> DataFrame:
    """``cut`` (see :func:`pieces`) with sequence_id and offset, without repeat.

    Groups are dealt by the hash of a piece's id and contents; sequence ids are the group times 2^32 plus a
    running number.  A partition takes a run of about ``partition_groups`` groups, more where there would be
    over ``most_partitions``.
    """
    names = [c for c in cut.columns if c != "repeat"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    width = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = min(most_partitions, groups, max(width, -(-groups // partition_groups)))
    hashed = F.xxhash64("doc_id", "start", "doc_tokens", "repeat", "ids")
    dealt = cut.withColumn("__group", F.pmod(hashed, F.lit(groups)).cast("long")).withColumn("__hash", hashed).drop("repeat")
    part = F.floor(F.col("__group") * width / groups).cast("int")
    dealt = dealt.withColumn("__part", part).repartitionById(width, "__part").drop("__part")
    dealt = dealt.sortWithinPartitions("__group", F.desc("length"), "__hash", "doc_id")

    def emit(table: pa.Table, sequence: list[int], offset: list[int]) -> Iterator[pa.RecordBatch]:
        out = table.select(names).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from out.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number = None, 0
        for group, table, whole in split(batches):
            if group != last:
                last, number = group, group << 32
            if whole:
                yield from emit(table, list(range(number, number + table.num_rows)), [0] * table.num_rows)
                number += table.num_rows
                continue
            waiting: dict[int, list[int]] = {}
            lengths = table.column("length").to_pylist()
            for i in range(len(lengths) - 1, -1, -1):
                waiting.setdefault(lengths[i], []).append(i)
            order, sequence, offset = [], [], []
            for members in bins(lengths, capacity):
                at = 0
                for n in members:
                    order.append(waiting[n].pop())
                    sequence.append(number)
                    offset.append(at)
                    at += n
                number += 1
            yield from emit(table.take(pa.array(order, pa.int64())), sequence, offset)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, bool]]:
        """Full windows batch by batch as they come first; then a group's ends together."""

        def marked() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.append_column("__rest", pc.less(b.column("length"), capacity))

        held_group, held = None, []
        for b in marked():
            for (group, rest), table in runs([b], ["__group", "__rest"]):
                if held and group != held_group:
                    yield held_group, pa.concat_tables(held), False
                    held = []
                if rest:
                    held_group = group
                    held.append(table)
                else:
                    yield group, table, True
        if held:
            yield held_group, pa.concat_tables(held), False

    return map_arrow(dealt, run, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, group_rows: int = 4096
) -> DataFrame:
    """Tokenize and pack all rows of ``docs``; about ``group_rows`` documents meet in a group."""
    groups = max(1, -(-docs.count() // group_rows))
    return pack(pieces(docs, tokenizer, capacity=capacity, end_id=end_id), capacity=capacity, groups=groups)


def padded_length(length: int, capacity: int = CAPACITY) -> int:
    """Length of a sequence as it is fed: the capacity, or its own where that is a power of two."""
    return length if length & (length - 1) == 0 else capacity
