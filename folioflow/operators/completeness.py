"""Formal completeness: projects, required types, assignments, counters, table-of-contents status."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage


def list_projects(projects: DataFrame, types: DataFrame, statuses: DataFrame, applicants: DataFrame, name: str | None = None) -> DataFrame:
    """Projects with their type and status (both must exist) and applicant (may be missing)."""
    out = projects if name is None else projects.where(F.col("name").ilike(f"%{name}%"))
    out = out.join(types.select("type_id", "type_name"), "type_id").join(statuses.select("status_id", "status_name"), "status_id")
    return out.join(applicants.select("project_id", "applicant_name"), "project_id", "left")


def types_by_category(categories: DataFrame, types: DataFrame) -> DataFrame:
    """Categories with the names of their types that are not deleted; categories without any stay, with no names."""
    live = types.where(~F.col("deleted")).select("category_id", "type_name")
    grouped = live.groupBy("category_id").agg(F.array_sort(F.collect_list("type_name")).alias("type_names"))
    out = categories.join(grouped, "category_id", "left")
    return out.withColumn("type_names", F.coalesce("type_names", F.array().cast("array<string>")))


def template_types(templates: DataFrame, categories: DataFrame) -> DataFrame:
    live = templates.where(~F.col("deleted")).join(categories.where(~F.col("deleted")).select("category_id", "category_name"), "category_id")
    return live.orderBy("category_name", "type_name")


def results(types: DataFrame, documents: DataFrame) -> DataFrame:
    """Each type with its assigned documents; null reasoning is blank, null confidence 0."""
    docs = documents.where(F.col("type_id").isNotNull()).groupBy("type_id").agg(
        F.array_sort(F.collect_list(F.struct("document_id", F.coalesce("reasoning", F.lit("")).alias("reasoning"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")))).alias("documents")
    )
    empty = F.array().cast(docs.schema["documents"].dataType)
    return types.where(~F.col("deleted")).join(docs, "type_id", "left").withColumn("documents", F.coalesce("documents", empty))


def unassigned(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("type_id").isNull())


def document_extractions(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """Documents with the extraction at the path their name gives; of equal paths the last one."""
    last = extractions.groupBy("path").agg(F.max_by("extraction_id", "ord").alias("extraction_id"))
    stem = F.regexp_replace("filename", r"\.[^./]*$", "")
    base = F.regexp_extract(stem, r"([^/]*)$", 1)
    return documents.withColumn("path", F.concat(stem, F.lit("/"), base, F.lit("_processed.json"))).join(last, "path")


#: Values that a confidence can have once it is rounded: hundredths from 0 to 1.
HUNDREDTHS = 101


def steps_table(factors: Iterable[float]) -> list[int]:
    """What a run of factors makes of each hundredth, rounded after every step as Python rounds.

    Steps keep the order of values, so equal results stay equal and are carried once: long runs soon carry one.
    """
    values, at = [k / 100 for k in range(HUNDREDTHS)], list(range(HUNDREDTHS))
    for x in factors:
        made = [round(v * x, 2) for v in values]
        if len(set(made)) < len(made):
            places = {v: n for n, v in enumerate(dict.fromkeys(made))}
            at = [places[made[n]] for n in at]
            made = list(places)
        values = made
    return [round(values[n] * 100) for n in at]


def type_confidence(matches: DataFrame) -> DataFrame:
    """type_id, confidence: products in result order, rounded to two places after every step, as Python rounds.

    After the first step a value is one of 101 hundredths, so a run of steps is a table of 101 results, and tables of
    neighbouring runs make one table.  Matches are range partitioned by type and order; a partition makes one table for
    each of its types, and a type's tables, at most one for each partition, are applied in their order.  So a type of any
    size is many tasks.  Types with a factor outside 0 to 1 have no such table: their matches pass through one task
    each, in order, a batch at a time.
    """
    value = F.col("confidence").cast("double")
    rows = matches.where(F.col("confidence").isNotNull()).select("type_id", value.alias("confidence"), "ord")
    kind = matches.schema["type_id"].dataType.simpleString()
    outside = rows.where(~F.col("confidence").between(0.0, 1.0) | F.isnan("confidence")).select("type_id").distinct()
    outside = stage(outside, "outside")
    on = F.col("type_id").eqNullSafe(F.col("__t"))
    wild = outside.withColumnRenamed("type_id", "__t")
    keys = ["type_id", "ord", "confidence"]
    ranged = rows.join(wild, on, "left_anti").repartitionByRange(*keys).sortWithinPartitions(*keys)
    tables = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_tables, f"type_id {kind}, part int, results array<smallint>")
    listed = tables.groupBy("type_id").agg(F.array_sort(F.collect_list(F.struct("part", "results"))).alias("runs"))
    last = F.aggregate("runs", F.lit(HUNDREDTHS - 1).cast("smallint"), lambda k, r: F.element_at(r["results"], k + 1))
    exact = listed.select("type_id", (last / F.lit(100.0)).alias("confidence"))
    single = rows.join(wild, on, "left_semi").repartition("type_id").sortWithinPartitions(*keys)
    return exact.unionByName(single.mapInArrow(_folded, f"type_id {kind}, confidence double"))


def _type_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[float]]]:
    """Types of a sorted partition with their factors in order."""
    columns = (zip(b.column("type_id").to_pylist(), b.column("confidence").to_pylist(), strict=True) for b in batches)
    for type_id, rows in groupby(chain.from_iterable(columns), key=lambda r: r[0]):
        yield type_id, (x for _, x in rows)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None or not first.num_rows and (first := next((b for b in batches if b.num_rows), None)) is None:
        return
    kind, part = first.schema.field("type_id").type, first.column("part")[0].as_py()
    for type_id, factors in _type_runs(chain([first], batches)):
        columns = [pa.array([type_id], kind), pa.array([part], pa.int32()), pa.array([steps_table(factors)], pa.list_(pa.int16()))]
        yield pa.RecordBatch.from_arrays(columns, names=["type_id", "part", "results"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    kind = first.schema.field("type_id").type
    for type_id, factors in _type_runs(chain([first], batches)):
        value = 1.0
        for x in factors:
            value = round(value * x, 2)
        yield pa.RecordBatch.from_arrays([pa.array([type_id], kind), pa.array([value], pa.float64())], names=["type_id", "confidence"])


def counters(types: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: matched types, assigned and unassigned documents, deleted types."""
    matched = documents.where("type_id is not null").select("type_id").distinct()
    a = types.join(matched.withColumn("m", F.lit(1)), "type_id", "left").agg(
        F.count_if(F.col("m").isNotNull() & ~F.col("deleted")).alias("matched"), F.count_if(F.col("deleted")).alias("deleted")
    )
    b = documents.agg(F.count("type_id").alias("assigned"), F.count_if(F.col("type_id").isNull()).alias("unassigned"))
    return a.join(b)


def contents_status(types: DataFrame, documents: DataFrame) -> DataFrame:
    """Per category: number of missing types (live, without a document) and status none, complete or missing."""
    held = documents.where("type_id is not null").select("type_id").distinct().withColumn("held", F.lit(True))
    live = types.where(~F.col("deleted")).join(held, "type_id", "left")
    out = types.groupBy("category_id").agg(F.count("*").alias("n_all")).join(
        live.groupBy("category_id").agg(F.count("*").alias("n_types"), F.count_if(F.col("held").isNull()).alias("n_missing")), "category_id", "left"
    )
    n, missing = F.coalesce("n_types", F.lit(0)), F.coalesce("n_missing", F.lit(0))
    return out.select("category_id", n.alias("n_types"), missing.alias("n_missing"), F.when(n == 0, "none").when(missing == 0, "complete").otherwise("missing").alias("status"))


def refine(matches: DataFrame) -> DataFrame:
    """Per document: one match wins, several go to a shortlist (best first), none leaves it unassigned."""
    grouped = matches.groupBy("document_id").agg(
        F.count("type_id").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("type_id").isNotNull(), F.struct((-F.col("confidence")).alias("c"), "type_id")))), lambda x: x["type_id"]).alias("shortlist"),
    )
    return grouped.select("document_id", F.when(F.col("n") == 0, "unassigned").when(F.col("n") == 1, "matched").otherwise("refine").alias("state"), "shortlist")


def guarded_index(index: Column, n: Column) -> Column:
    """Positions out of range become -1."""
    return F.when((index >= 0) & (index < n), index).otherwise(-1)


def flatten_requirements(folders: DataFrame) -> DataFrame:
    """Nested requirement folders to rows: category, name, description (requirements, else the name), optional."""
    one = folders.select(F.col("name").alias("category"), F.explode("children").alias("c"))
    text = F.trim(F.col("c.contentRequirements"))
    return one.select("category", F.col("c.name").alias("name"), F.coalesce(F.nullif(text, F.lit("")), "c.name").alias("description"), (~F.coalesce("c.required", F.lit(True))).alias("optional"))


def failure_gate(rows: DataFrame, most: float = 0.30) -> DataFrame:
    """One row: rate of rows with an error (1 without rows) and whether it is within the limit."""
    rate = F.coalesce(F.avg(F.col("error").isNotNull().cast("double")), F.lit(1.0))
    return rows.agg(rate.alias("rate")).withColumn("passed", F.col("rate") <= most)


def contents_to_types(entries: DataFrame) -> DataFrame:
    """Entries of a table of contents as type definitions: category is the path, the number leads the description."""
    numbered = F.concat_ws(": ", F.nullif("number", F.lit("")), "title")
    return entries.select(F.array_join("path", " > ").alias("category"), F.col("title").alias("document_type"), numbered.alias("description"))


def valid_interval(start: Column, end: Column) -> Column:
    return F.coalesce(start <= end, F.lit(True))


def source_reference(kind: Column, item: Column) -> Column:
    """A comment's source as a struct; null where a kind other than manual lacks its item."""
    ok = kind.isNotNull() & ((kind == "manual") | (F.coalesce(item, F.lit("")) != ""))
    return F.when(ok, F.struct(kind.alias("type"), item.alias("item_id")))
