"""WARC archives whose records are compressed one by one against an embedded Zstandard dictionary.

Method: every task writes archives of its own.  It builds a dictionary from the first records of an archive
(a bounded sample), puts it into a leading skippable frame (magic 0x184D2A5D) and compresses each record as
a frame of its own, so any record can be read alone.  Records whose payload is archived elsewhere are
``revisit`` records.  Archives have a name of their own per task attempt; the manifest, written by Spark,
names those of the attempts that counted, so lost executors leave no wrong file in it.

Cases: a null html is an empty payload; a null url is an empty target.  Of equal payloads the rows of the
largest ``page_id`` are responses (all of them, if that id is repeated), the others revisit it.  A null
``page_id`` is smaller than any other; where all are null, all are responses.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, new_path, stage

#: Fixed values of the formats.
SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")
DICTIONARY = (0xEC30A437).to_bytes(4, "little")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as both Hadoop and Arrow understand it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without the payload if ``refers_to`` is given."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Full-Payload-Length", str(len(payload)))]
        return _record(fields, http)
    return _record(fields, http + payload)


class Archive:
    """One archive file: records wait until the dictionary's sample is complete."""

    def __init__(self, fs: pafs.FileSystem, path: str, sample_bytes: int, dictionary_bytes: int, level: int):
        self.path, self.sample_bytes, self.dictionary_bytes, self.level = path, sample_bytes, dictionary_bytes, level
        self.out = fs.open_output_stream(path, compression=None)
        self.waiting: list[bytes] | None = []
        self.held = self.records = self.raw_bytes = self.bytes = self.used = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        self.raw_bytes += len(record)
        if self.waiting is None:
            self._write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= self.sample_bytes:
            self._begin()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _begin(self) -> None:
        data = build_dictionary(self.waiting or [], self.dictionary_bytes)
        if data:
            self._write(SKIPPABLE + len(data).to_bytes(4, "little") + data)
        self.used = len(data)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        waiting, self.waiting = self.waiting or [], None
        for record in waiting:
            self._write(self.compressor.compress(record))

    def close(self) -> None:
        if self.waiting is not None:
            self._begin()
        self.out.close()


def build_dictionary(records: list[bytes], size: int) -> bytes:
    """A trained dictionary; records too few or too alike to train one give their last bytes as raw content."""
    if len(records) >= 16:
        try:
            return zstandard.train_dictionary(size, records, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(records)[-size:]


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    min_bytes: int = 0,
    sample_bytes: int = 1 << 20,
    dictionary_bytes: int = 1 << 15,
    archive_bytes: int = 1 << 28,
    level: int = 3,
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; the manifest: path, records, raw_bytes, bytes, dictionary_bytes.

    ``sample_bytes`` bounds what a dictionary is built from, ``archive_bytes`` the raw size of an archive.
    Payloads of fewer than ``min_bytes`` bytes are never revisits.  The pages are shuffled once, by their
    digest; a frequent payload is a skewed key of a left join that Spark can split.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    read = pages.select("page_id", "url", payload.alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    equal = read.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    equal = equal.where("n > 1").select(F.col("digest").alias("__digest"), "kept")
    told = read.join(equal, F.col("digest") == F.col("__digest"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    rows = told.select("page_id", "url", F.encode("html", "UTF-8").alias("payload"), refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        archive, done = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                    if archive is None:
                        fs.create_dir(root, recursive=True)
                        archive = Archive(fs, f"{root}/{uuid.uuid4().hex}.warc.zst", sample_bytes, dictionary_bytes, level)
                        archive.add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info>"), ("WARC-Date", EPOCH)], b""))
                    archive.add(page_record(*row))
                    if archive.raw_bytes >= archive_bytes:
                        archive.close()
                        done.append(archive)
                        archive = None
        if archive is not None:
            archive.close()
            done.append(archive)
        yield pa.RecordBatch.from_pylist(
            [{"path": f"{folder}/{a.path.rsplit('/', 1)[1]}", "records": a.records - 1, "raw_bytes": a.raw_bytes, "bytes": a.bytes, "dictionary_bytes": a.used} for a in done],
            pa.schema([("path", pa.string())] + [(n, pa.int64()) for n in ("records", "raw_bytes", "bytes", "dictionary_bytes")]),
        )

    return stage(map_arrow(rows, run, "path string, records long, raw_bytes long, bytes long, dictionary_bytes long"), "manifest")


def read_records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an archive, streamed."""
    head = stream.read(8)
    data = None
    if head[:4] == SKIPPABLE:
        data = stream.read(int.from_bytes(head[4:], "little"))
        head = b""
    kind = zstandard.DICT_TYPE_FULLDICT if data and data[:4] == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind) if data else None).stream_reader(
        _Joined(head, stream), read_across_frames=True
    )
    plain = io.BufferedReader(reader, 1 << 20)
    while line := plain.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record at {line[:40]!r}")
        fields = {}
        while (line := plain.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = plain.read(int(fields["Content-Length"]))
        plain.read(4)
        yield fields, block


class _Joined(io.RawIOBase):
    """Bytes that were read ahead, then the stream."""

    def __init__(self, head: bytes, rest: io.RawIOBase):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        if self.head:
            out, self.head = self.head, b""
            return out
        return self.rest.read(size)


def _page(urn: str | None) -> int | None:
    inside = (urn or "")[len("<urn:page:") : -1]
    return int(inside) if inside else None


def read_archives(manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Every page record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Digests of responses are recomputed from what was read and must equal the header.  ``payload`` is null
    for revisits, and everywhere if ``payloads`` is false.
    """
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
        + [("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(inner, compression=None, buffer_size=1 << 20) as stream:
                    for fields, block in read_records(stream):
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if payload is not None and payload_digest(payload) != digest:
                            raise ValueError(f"digest of {fields['WARC-Record-ID']} in {path} differs")
                        size = len(payload) if payload is not None else int(fields["WARC-Full-Payload-Length"])
                        page, other = _page(fields["WARC-Record-ID"]), _page(fields.get("WARC-Refers-To"))
                        rows.append((page, fields["WARC-Target-URI"], size, digest, kind, other, payload if payloads else None))
                        held += len(payload or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    paths = manifest.select("path")
    return map_arrow(
        paths.repartition(max(1, paths.count())),
        run,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )


def archive_pages(pages: DataFrame, *, folder: str | None = None, payloads: bool = False, **params) -> DataFrame:
    """Write archives, into a folder of the shared one unless given, and read them back."""
    spark = pages.sparkSession
    where = qualified(spark, folder or new_path(spark, "warc"))
    return read_archives(write_archives(pages, where, **params), payloads=payloads)
