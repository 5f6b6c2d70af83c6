"""Archives, chat masks, packing, mixing and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import chat_format, mixing, packing, queries, warc
from folioflow.llm.common import stage
from tests.conftest import same_rows

BYTES = queries.tokenizer_path(queries.CHAT_TOKENIZER)
WORDS = queries.tokenizer_path(queries.WORD_TOKENIZER)


def test_warc_matches_sql(spark, sf, duck):
    same_rows(queries.op2_warc(spark, sf), duck.sql(queries.OP2_SQL))


def test_warc_round_trip_and_edges(spark, tmp_path):
    rows = [(1, None, None, 5), (2, "u", "", 5), (None, "u", "é", 5), (5, "u\nx", "é", 5), (5, "u", "é", 5), (7, "v", "z" * 300_000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kept int")
    found = warc.archive_pages(pages, folder=f"file://{tmp_path}/a", payloads=True, sample_bytes=100, archive_bytes=1000).collect()
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found)
    assert got == [(0, "revisit", 5, 2), (1, "revisit", 2, 0), (2, "response", None, 0), (5, "response", None, 2), (5, "response", None, 2), (7, "response", None, 300_000)]
    assert {bytes(r["payload"]).decode() for r in found if r["payload"] is not None} == {"", "é", "z" * 300_000}
    small = warc.archive_pages(pages, min_bytes=2)
    assert Counter(r["record_type"] for r in small.collect()) == {"response": 5, "revisit": 1}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_records_are_readable_alone(spark, tmp_path):
    """Each frame is cut out by its offset and decompressed by itself, with nothing but the leading dictionary."""
    import zstandard

    pages = spark.createDataFrame([(i, f"u{i}", f"<html>{i} shared words in every page" * 20) for i in range(50)], "page_id long, url string, html string")
    made = warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/a", sample_bytes=20_000, dictionary_bytes=2048).collect()
    found = []
    for m in made:
        data = open(m["path"].removeprefix("file://"), "rb").read()
        assert data[:4] == warc.SKIPPABLE and m["dictionary_bytes"] > 0
        at = 8 + int.from_bytes(data[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(data[8:at])
        while at < len(data):
            one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            record = one.decompress(data[at:])
            at = len(data) - len(one.unused_data)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            found.append(record)
    assert sum(b"WARC-Type: warcinfo" in r for r in found) == len(made) and len(found) == 50 + len(made)
    assert {int(r.split(b"<urn:page:")[1].split(b">")[0]) for r in found if b"<urn:page:" in r} == set(range(50))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\>aé", max_size=20))
def test_escape_is_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert "<|" not in chat_format.escape(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text(alphabet="ab <|\\> \n🎉é", max_size=12)), max_size=6))
def test_masks_cover_exactly_the_learned_texts(turns):
    tokenizer = chat_format.load_tokenizer(BYTES)
    formatted, spans = chat_format.render(turns)
    assert chat_format.parse(formatted) == turns
    e = tokenizer.encode(formatted, add_special_tokens=False)
    offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
    mask = chat_format.mask_tokens(offsets, spans)
    assert chat_format.masked_text(formatted, offsets, mask) == "".join(t for r, t in turns if r == "assistant")
    assert tokenizer.decode(e.ids, skip_special_tokens=False) == formatted


def test_chat_matches_sql(spark, sf, duck):
    same_rows(queries.op8_chat_format(spark, sf), duck.sql(queries.OP8_SQL))


def test_chat_edges(spark):
    rows = [(1, 0, "assistant", "x<|"), (1, 0, "assistant", "x<|"), (1, None, None, None), (None, 0, "assistant", ""), (2, 3, "assistant", "<|im_sep|>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    whole = chat_format.digest(chat_format.format_conversations(df, BYTES)).collect()
    parts = chat_format.digest(chat_format.format_conversations(df, BYTES, part_chars=3)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts))
    assert {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in whole} == {1: (3, 6), None: (1, 0), 2: (1, 10)}
    assert chat_format.digest(chat_format.format_conversations(df.limit(0), BYTES)).count() == 0


def test_streamed_encoding_equals_one_encoding(spark):
    """Ids, offsets and masks of the parts of a long conversation are those of one encoding of the whole string."""
    said = ["Grüße <|im_end|> an alle", " two  spaces\n\n", "", "🎉 x" * 50, "tail\u0301 of words"]
    turns = [(i, "assistant" if i % 2 else "user", said[i % 5] + str(i)) for i in range(200)]
    df = spark.createDataFrame([(7, *t) for t in turns], "conv_id long, turn long, role string, text string")
    parts = sorted(chat_format.format_conversations(df, BYTES, part_chars=500).collect(), key=lambda r: r["part"])
    assert len(parts) > 10
    formatted, spans = chat_format.render([t[1:] for t in turns])
    e = chat_format.load_tokenizer(BYTES).encode(formatted, add_special_tokens=False)
    offsets = np.array(e.offsets)
    assert "".join(r["formatted"] for r in parts) == formatted and [i for r in parts for i in r["ids"]] == e.ids
    at, found, mask = 0, [], []
    for r in parts:
        found += [(a + at, b + at) for a, b in zip(r["starts"], r["ends"], strict=True)]
        mask += r["mask"]
        at += len(r["formatted"])
    assert found == [tuple(o) for o in offsets.tolist()] and mask == chat_format.mask_tokens(offsets, spans).tolist()


@pytest.mark.parametrize("kind", ["int", "string", "decimal(10,2)", "date"])
def test_chat_ids_of_any_type(spark, kind):
    df = spark.createDataFrame([(i % 3, i, "assistant", f"t{i}") for i in range(9)], "conv_id int, turn long, role string, text string")
    made = F.date_add(F.lit("2024-01-01").cast("date"), F.col("conv_id")) if kind == "date" else F.col("conv_id").cast(kind)
    out = chat_format.digest(chat_format.format_conversations(df.withColumn("conv_id", made), BYTES))
    assert out.schema["conv_id"].dataType.simpleString() == kind
    assert sorted((r["n_turns"], r["loss_chars"]) for r in out.collect()) == [(3, 6)] * 3 and len({r["conv_id"] for r in out.collect()}) == 3


def test_digest_refuses_parts_out_of_order(spark):
    df = spark.createDataFrame([(1, i, "user", "x" * 20) for i in range(9)], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(df, BYTES, part_chars=10).coalesce(1).sortWithinPartitions(F.desc("part"))
    with pytest.raises(Exception, match="does not follow"):
        chat_format.digest(formatted).collect()


ENCODER = packing.WordEncoder(WORDS)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aB1éÀ_.,'s \t\x1c\x85\u0301\u2019²İΣ\xa0!", max_size=40) | st.text(max_size=20))
def test_word_encoder_equals_library(text):
    encode = ENCODER
    ids = np.frombuffer(next(iter(encode([text]))), "<u4").tolist()
    assert encode.quick and ids == encode.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(1, 60))
def test_fill_is_closest(lengths, room):
    picked = packing.fill(dict(Counter(lengths)), room)
    total = sum(n * k for n, k in picked.items())
    assert all(k <= lengths.count(n) for n, k in picked.items())
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums}
    assert total == max(s for s in sums if s <= room)


def check_packed(rows, capacity=4096):
    of_sequence, of_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        of_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        of_doc[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    padding = 0
    for pieces in of_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += packing.padded_length(at, capacity) - at
    return of_doc, padding


def test_packing_holds_every_id_once(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op10_packing(spark, sf).collect()
    of_doc, padding = check_packed(rows)
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert (zlib.crc32(part.tobytes()), r["doc_tokens"]) == (r["ids_crc32"], len(ids[r["doc_id"]]))
    for d, pieces in of_doc.items():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at
            at += length
        assert at == total == len(ids[d])
    assert set(of_doc) == set(ids) and padding < 0.02 * sum(map(len, ids.values()))


def test_packing_edges(spark):
    rows = [(None, None, 1), (1, "", 1), (1, "", 1), (2, "word " * 20_000, 1), (3, "<|endoftext|> a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    found = packing.pack_documents(docs, WORDS, group_rows=2).collect()
    check_packed(found)
    assert sum(r["length"] for r in found) == 20_001 + 3 + 3
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_equal_rows_spread_over_groups(spark):
    docs = spark.createDataFrame([(1, "same words")] * 3000 + [(i, f"other {i}") for i in range(2, 50)], "doc_id long, text string").repartition(3)
    found = packing.pack_documents(docs, WORDS, group_rows=300).collect()
    of_group = Counter(r["sequence_id"] >> 32 for r in found if r["doc_id"] == 1)
    assert sum(of_group.values()) == 3000 and len(of_group) == 11 and max(of_group.values()) < 600
    check_packed(found)


def levels(sizes, weights, cap=3.0):
    """Water filling by bisection."""
    low, high, total = 0.0, 1e12, sum(sizes)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(cap * s, w * mid) for s, w in zip(sizes, weights, strict=True)) < total:
            low = mid
        else:
            high = mid
    return [min(cap * s, w * high) for s, w in zip(sizes, weights, strict=True)]


def test_mixing_meets_targets(spark):
    sizes = {"a": 300, "B": 20, "z": 50, None: 900, "é": 3}
    rows, k = [], 0
    for source, n in sizes.items():
        for i in range(n):
            rows.append((k, "w " * (i % 7), source, 1))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    found = mixing.mix_report(docs, bucket_rows=16, fan=4).collect()
    totals = defaultdict(int)
    for r in found:
        totals[r["source"]] += r["size"]
    order = sorted((s for s in totals if s is not None)) + [None]
    goal = dict(zip(order, levels([totals[s] for s in order], [1, 2, 3, 1, 2]), strict=True))
    taken, longest = defaultdict(int), 6
    for r in found:
        assert abs(r["target"] - goal[r["source"]]) < 1e-3 and r["source_size"] == totals[r["source"]]
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(found) == len(rows) and all(abs(taken[s] - goal[s]) <= longest for s in order)
    again = mixing.mix_report(docs.repartition(3), bucket_rows=16, fan=4).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    mixed = mixing.mix_documents(docs, bucket_rows=16, fan=4)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in found if r["copies"]})


def test_mixing_keeps_expectations():
    runs, n = 400, 40
    rng = np.random.default_rng(1)
    mass, words = rng.uniform(0.05, 0.95, n).tolist(), rng.integers(1, 50, n).tolist()
    total = np.zeros(n)
    for s in range(runs):
        out, rest = mixing.pivot(mass, words, np.random.default_rng(s).integers(-(2**62), 2**62, n))
        assert abs(np.dot(out, words) - np.dot(mass, words)) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != rest)
        total += out
    assert np.abs(total / runs - mass).max() < 0.13


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "", "a"), (2, "x y", "a"), (2, "x y", "a")], "doc_id long, text string, source string")
    found = mixing.mix_report(docs).collect()
    assert len(found) == 4 and len({r["copies"] for r in found if r["doc_id"] == 2}) == 1
    assert mixing.mix_report(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs.where("text is null")).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, seen = docs, []
    for name, function in corpus_pipeline.STAGES:
        now = stage(function(spark, now, sf), "test")
        seen.append(now)
        if name != "packing":
            assert now.columns == docs.columns
    quality, unique, clean, mixed, packed = seen
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    assert 0 < len(ids(unique)) < len(ids(quality)) < docs.count()
    assert sorted(ids(clean)) == sorted(ids(unique)) and set(ids(mixed)) <= set(ids(clean))
    from tests.llm.test_pairs import brute_jaccard, components

    texts = {r["doc_id"]: r["text"] for r in quality.collect()}
    least = components(texts, brute_jaccard(texts))
    assert set(ids(unique)) == {d for d in texts if least[d] == d}
    of_doc, _ = check_packed(packed.collect())
    assert set(of_doc) == set(ids(mixed))
    assert corpus_pipeline.run(spark, sf).count() == packed.count()
