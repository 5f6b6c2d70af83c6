"""ZIP archives: their directories, entries in parts that tasks share, validated and staged; digests of files.

An archive is split by its central directory: its entries are dealt, in ranges of about ``range_bytes`` packed bytes, over
the tasks, and each task reads only the bytes of its entries.  So one archive of 10 GB is many tasks, and an entry that
cannot be read is one row with an error beside the good ones.  Entries pass through a megabyte at a time.

Paths are what Arrow's file systems open (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normal_entry_name, upload_error
from ..plans.staging import stage

#: Limits of an archive.
MOST_ENTRIES, MOST_BYTES, MOST_RATIO = 5000, 10 * 1024**3, 100.0
#: Packed bytes of the entries that one task reads, bytes read at once, bytes of an entry's beginning that tell its type.
RANGE_BYTES, STEP, HEAD_BYTES = 64 << 20, 1 << 20, 512

DIRECTORY = pa.schema([("path", pa.string()), ("number", pa.int32()), ("entry_name", pa.string()), ("is_dir", pa.bool_()), ("unix_mode", pa.int32()), ("file_size", pa.int64()), ("compress_size", pa.int64()), ("error", pa.string())])
_DIRECTORY_DDL = "path string, number int, entry_name string, is_dir boolean, unix_mode int, file_size long, compress_size long, error string"
#: What reading a damaged or refused entry raises.
UNREADABLE = (OSError, ValueError, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    # one slash after "file:" is what Spark writes
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def is_link(mode: int) -> bool:
    return mode & 0o170000 == 0o120000


def _violation(listed: list[zipfile.ZipInfo], most_entries: int, most_bytes: int, most_ratio: float) -> str | None:
    """Why an archive is refused, from its directory alone; folders and links do not count as size."""
    if len(listed) > most_entries:
        return "too many entries"
    files = [i for i in listed if not i.is_dir() and not is_link(i.external_attr >> 16)]
    if any(i.file_size > most_bytes for i in files) or sum(i.file_size for i in files) > most_bytes:
        return "too large"
    if any(i.compress_size > 0 and i.file_size / i.compress_size > most_ratio for i in files):
        return "compressed too well"
    return None


def directories(archives: DataFrame, *, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES, most_ratio: float = MOST_RATIO) -> DataFrame:
    """Entries of archives (``path``) as their directories list them; nothing is inflated.

    A broken or refused archive is one row with ``error``.
    """

    def entries(path: str) -> list[tuple]:
        try:
            fs, inner = opened(path)
            with fs.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                listed = z.infolist()
        except UNREADABLE as e:
            return [(path, *[None] * 6, f"{type(e).__name__}: {e}")]
        if problem := _violation(listed, most_entries, most_bytes, most_ratio):
            return [(path, *[None] * 6, problem)]
        return [(path, n, i.filename, i.is_dir(), i.external_attr >> 16, i.file_size, i.compress_size, None) for n, i in enumerate(listed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if rows := entries(path):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), DIRECTORY.types, strict=True)], schema=DIRECTORY)

    return archives.select("path").mapInArrow(run, _DIRECTORY_DDL)


def dealt(entries: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``entries`` with the range of their archive that they are read in, brought together by archive and range."""
    before = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("compress_size").over(before), F.lit(0))
    return entries.withColumn("range", F.floor(start / range_bytes)).repartition("path", "range").sortWithinPartitions("path", "range", "number")


class Reader:
    """Opens entries of the archive at hand; a task's entries come archive by archive."""

    def __init__(self):
        self.path, self.file, self.zip, self.listed = None, None, None, []

    def parts(self, path: str, number: int) -> Iterator[bytes]:
        if path != self.path:
            self.close()
            fs, inner = opened(path)
            self.file = fs.open_input_file(inner)
            self.zip = zipfile.ZipFile(self.file)
            self.path, self.listed = path, self.zip.infolist()
        with self.zip.open(self.listed[number]) as entry:
            while part := entry.read(STEP):
                yield part

    def close(self) -> None:
        for held in (self.zip, self.file):
            if held is not None:
                held.close()
        self.path = self.file = self.zip = None


def _each_entry(entries: DataFrame, work, added: pa.Schema, ddl: str) -> DataFrame:
    """``entries`` with what ``work(reader, row)`` returns for each, or ``error`` where it fails."""
    kept = [c for c in entries.columns if c != "error"]
    kinds = {f.name: f.dataType.simpleString() for f in entries.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        try:
            for batch in batches:
                found = []
                for row in batch.to_pylist():
                    try:
                        found.append({**work(reader, row), "error": None})
                    except UNREADABLE as e:
                        found.append({"error": f"{type(e).__name__}: {e}"})
                more = pa.Table.from_pylist(found, schema=added.append(pa.field("error", pa.string())))
                for piece in more.to_batches() or [pa.RecordBatch.from_pylist([], schema=more.schema)]:
                    yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *piece.columns], names=[*kept, *piece.schema.names])
        finally:
            reader.close()

    return entries.select(*kept).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], ddl, "error string"]))


def _hashed(reader: Reader, row: dict) -> dict:
    if row["is_dir"]:
        return {}
    digest, head = hashlib.sha256(), b""
    for part in reader.parts(row["path"], row["number"]):
        digest.update(part)
        head = head or part[:HEAD_BYTES]
    return {"sha256": digest.hexdigest(), "head": head}


def zip_entries(archives: DataFrame, *, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES, most_ratio: float = MOST_RATIO, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Entries of ZIP archives (``path``) with normal_name, sha256 and head (their first bytes); one row an entry.

    A broken or refused archive is one row with ``error``, and so is an entry that cannot be read; the others are whole.
    """
    listed = stage(directories(archives, most_entries=most_entries, most_bytes=most_bytes, most_ratio=most_ratio), "directories")
    read = _each_entry(dealt(listed.where("error is null"), range_bytes), _hashed, pa.schema([("sha256", pa.string()), ("head", pa.binary())]), "sha256 string, head binary")
    refused = listed.where("error is not null")
    return read.drop("range").unionByName(refused, allowMissingColumns=True).withColumn("normal_name", normal_entry_name(F.col("entry_name")))


def _staged(folder: str):
    def write(reader: Reader, row: dict) -> dict:
        fs, base = opened(folder)
        target = f"{base}/{row['place']}"
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            return {"bucket_path": f"{folder}/{row['place']}"}
        fs.create_dir(target.rsplit("/", 1)[0])
        # a task that is lost leaves a part of its own, never half a file under the name
        part = f"{target}.{uuid.uuid4().hex}.part"
        try:
            with fs.open_output_stream(part) as out:
                for piece in reader.parts(row["path"], row["number"]):
                    out.write(piece)
            fs.move(part, target)
        except UNREADABLE:
            if fs.get_file_info(part).type != pafs.FileType.NotFound:
                fs.delete_file(part)
            raise
        return {"bucket_path": f"{folder}/{row['place']}"}

    return write


def stage_archives(archives: DataFrame, folder: str, types: dict[str, str], allowed: list[str], prefix: Column | None = None, **limits) -> DataFrame:
    """The files of archives, validated and copied to ``folder``: path, filename, success, bucket_path, sha256, error_code, error.

    Folders, links and names that are not safe are skipped.  A file whose name or content is not allowed is a row with
    VALIDATION_FAILED, one that cannot be read with UNREADABLE, an archive that is broken or refused with ZIP_INVALID; the
    rest is staged.  A file that is there already stays; of entries with one name the first is staged and all are reported.
    ``prefix`` (of an archive's columns) is a folder for each archive.
    """
    columns = archives.withColumn("__prefix", F.lit("") if prefix is None else F.concat(prefix, F.lit("/")))
    entries = stage(zip_entries(columns, **limits), "entries")
    mode = F.coalesce(F.col("unix_mode"), F.lit(0))
    kept = (F.col("normal_name").isNotNull() & ~F.col("is_dir") & (mode.bitwiseAND(0o170000) != 0o120000)) | F.col("entry_name").isNull()
    rows = entries.where(kept).join(columns.select("path", "__prefix").distinct(), "path")
    invalid = upload_error(F.col("normal_name"), F.col("head"), types, allowed)
    code = F.when(F.col("entry_name").isNull(), "ZIP_INVALID").when(F.col("error").isNotNull(), "UNREADABLE").when(invalid.isNotNull(), "VALIDATION_FAILED")
    rows = rows.withColumn("error_code", code).withColumn("error", F.coalesce("error", F.when(F.col("entry_name").isNotNull(), invalid)))
    rows = rows.withColumn("place", F.concat("__prefix", "normal_name")).select("path", "number", "normal_name", "compress_size", "place", "sha256", "error_code", "error")
    good = rows.where("error_code is null")
    first = good.groupBy("place").agg(F.min(F.struct("path", "number", "compress_size")).alias("f")).select("place", "f.*")
    written = _each_entry(dealt(first), _staged(folder), pa.schema([("bucket_path", pa.string())]), "bucket_path string")
    staged = good.drop("error", "error_code").join(written.select("place", "bucket_path", "error"), "place")
    staged = staged.withColumn("error_code", F.when(F.col("error").isNotNull(), "UNREADABLE"))
    out = staged.unionByName(rows.where("error_code is not null"), allowMissingColumns=True)
    return out.select("path", F.col("normal_name").alias("filename"), F.col("error_code").isNull().alias("success"), "bucket_path", "sha256", "error_code", "error")


def zip_guard(entries: DataFrame, *, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES, most_ratio: float = MOST_RATIO) -> DataFrame:
    """Per archive of a table of entries: n_entries, total_size, largest, ratio and whether the limits hold.

    Folders and links do not count as size; an entry packed into no bytes has no ratio.
    """
    link = (F.col("unix_mode").bitwiseAND(0o170000)) == 0o120000
    counts = ~F.coalesce(F.col("is_dir"), F.lit(False)) & ~F.coalesce(link, F.lit(False))
    size, packed = F.when(counts, F.col("file_size")), F.when(counts, F.col("compress_size"))
    out = entries.groupBy("path").agg(
        F.count("*").alias("n_entries"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_size"),
        F.coalesce(F.max(size), F.lit(0)).alias("largest"),
        F.max(F.when(packed > 0, size / packed)).alias("ratio"),
    )
    ok = (F.col("n_entries") <= most_entries) & (F.col("largest") <= most_bytes) & (F.col("total_size") <= most_bytes)
    return out.withColumn("accepted", ok & (F.coalesce("ratio", F.lit(0.0)) <= most_ratio))


def file_digests(files: DataFrame) -> DataFrame:
    """path, sha256, size, error of files (``path``) of any size, read a megabyte at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                digest, size = hashlib.sha256(), 0
                try:
                    fs, inner = opened(path)
                    with fs.open_input_file(inner) as f:
                        while part := f.read(STEP):
                            digest.update(part)
                            size += len(part)
                    found.append((path, digest.hexdigest(), size, None))
                except (OSError, ValueError) as e:
                    found.append((path, None, None, str(e)))
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "sha256", "size", "error"])

    return files.select("path").mapInArrow(run, "path string, sha256 string, size long, error string")


def write_archives(files: DataFrame, folder: str, entries: int = 1000, packed: bool = True) -> DataFrame:
    """``files`` (name, content: binary) as ZIP archives of ``folder``, at most ``entries`` in each; returns their paths.

    Contents that pack better than ``MOST_RATIO`` are refused when they are read; not ``packed`` they pass.  Each task writes archives of its own and moves them to their names when they are whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        fs.create_dir(base)
        for batch in batches:
            for start in range(0, batch.num_rows, entries):
                name = f"{uuid.uuid4().hex}.zip"
                with fs.open_output_stream(f"{base}/{name}.part") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED) as z:
                    for row in batch.slice(start, entries).to_pylist():
                        z.writestr(row["name"], row["content"] or b"")
                fs.move(f"{base}/{name}.part", f"{base}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

    return files.select("name", "content").mapInArrow(run, "path string")
