"""Processed documents as a Spark data source: chunks of JSON files, page by page, with filters that reach the reader.

``spark.read.format("processed_documents").option("path", folder).load()`` has a row for each chunk.  Filters on
``document_name`` choose the files that are opened (none is listed for names that are given), filters on ``seq`` and
``first_page`` the chunks that leave the reader.  A partition is one page of ``page_size`` files.  Files have the name of
their document and the ending ``.json``; they are read with Arrow's file systems.

A document that is asked for (by a filter or the option ``names``) and is not there, or cannot be read, is one row with
``error``; its ``first_page`` is 0, so a filter on pages keeps it, and its ``seq`` is null.  A chunk without pages has no
``first_page`` and passes no filter on it.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

# readers are planned in Python processes that may not find this package: they get the code itself
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "processed_documents"
SCHEMA = "document_name string, seq int, chunk_id string, page_content string, page_numbers array<int>, first_page int, sub_chunks array<struct<chunk_id:string,page_content:string,page_numbers:array<int>>>, error string"
PAGE_SIZE = 500
BATCH_ROWS = 1000

_SUB = pa.struct([("chunk_id", pa.string()), ("page_content", pa.string()), ("page_numbers", pa.list_(pa.int32()))])
ARROW = pa.schema([("document_name", pa.string()), ("seq", pa.int32()), ("chunk_id", pa.string()), ("page_content", pa.string()), ("page_numbers", pa.list_(pa.int32())), ("first_page", pa.int32()), ("sub_chunks", pa.list_(_SUB)), ("error", pa.string())])

#: What a filter says about a number of a row.
HOLDS = {EqualTo: lambda x, v: x == v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v}


def file_system(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


class Page(InputPartition):
    """Names of documents that one task reads."""

    def __init__(self, names: list[str]):
        super().__init__(tuple(names))


class Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str] | None, page_size: int):
        self.path, self.names, self.page_size = path, names, page_size
        self.tests: list[tuple[str, type, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, kind = getattr(f, "attribute", ()), type(f)
            if column == ("document_name",) and kind in (EqualTo, In):
                wanted = [f.value] if kind is EqualTo else list(f.value)
                self.names = [n for n in wanted if n is not None and (self.names is None or n in self.names)]
            elif column in (("first_page",), ("seq",)) and kind in (*HOLDS, IsNotNull):
                self.tests.append((column[0], kind, getattr(f, "value", None)))
            elif column == ("document_name",) and kind is IsNotNull:
                continue
            else:
                yield f  # Spark's to hold

    def partitions(self) -> list[Page]:
        import pyarrow.fs as pafs

        names = self.names
        if names is None:
            fs, base = file_system(self.path)
            listed = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
            names = [i.base_name.removesuffix(".json") for i in listed if i.base_name.endswith(".json")]
        names = sorted(set(names))
        return [Page(names[i : i + self.page_size]) for i in range(0, len(names), self.page_size)] or [Page([])]

    def passes(self, row: dict) -> bool:
        return all(row[c] is not None and (kind is IsNotNull or HOLDS[kind](row[c], v)) for c, kind, v in self.tests)

    def rows(self, fs, base: str, name: str) -> Iterator[dict]:
        try:
            with fs.open_input_stream(f"{base}/{name}.json") as f:
                chunks = json.loads(f.read().decode("utf-8"))["chunks"] or []
        except FileNotFoundError:
            yield {"document_name": name, "seq": None, "first_page": 0, "error": "not found"}
            return
        except (OSError, ValueError, KeyError, TypeError) as e:
            yield {"document_name": name, "seq": None, "first_page": 0, "error": f"{type(e).__name__}: {e}"}
            return
        for seq, c in enumerate(chunks):
            pages = c.get("page_numbers") or []
            subs = [{k: s.get(k) for k in ("chunk_id", "page_content", "page_numbers")} for s in c.get("sub_chunks") or []]
            yield {"document_name": name, "seq": seq, "chunk_id": c.get("chunk_id"), "page_content": c.get("page_content"), "page_numbers": pages, "first_page": min(pages, default=None), "sub_chunks": subs, "error": None}

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(self.path)
        held: list[dict] = []
        for name in partition.value:
            held += [r for r in self.rows(fs, base, name) if self.passes(r)]
            while len(held) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(held[:BATCH_ROWS], schema=ARROW)
                held = held[BATCH_ROWS:]
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=ARROW)


class ProcessedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        names = self.options.get("names")
        return Reader(self.options["path"], json.loads(names) if names else None, int(self.options.get("page_size", PAGE_SIZE)))


def read_chunks(spark: SparkSession, path: str, names: list[str] | None = None, page_size: int = PAGE_SIZE) -> DataFrame:
    """Chunks of the processed documents of a folder, of ``names`` alone if given; filters go down to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProcessedDocuments)
    reader = spark.read.format(NAME).option("path", path).option("page_size", page_size)
    return (reader if names is None else reader.option("names", json.dumps(names))).load()


def write_each(documents: DataFrame, path: str) -> None:
    """Sink: a JSON file for each document (document_name, and any columns), whole or not at all."""
    columns = [c for c in documents.columns if c != "document_name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = file_system(path)
        fs.create_dir(base)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{base}/{name}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as f:
                    f.write(text.encode("utf-8"))
                fs.move(part, f"{base}/{name}.json")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    from pyspark.sql import functions as F

    documents.select("document_name", F.to_json(F.struct("document_name", *columns))).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
