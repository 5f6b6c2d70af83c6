"""What a layout service returns, as tables: references, markdown in reading order, content lists, table data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from .graph import root_paths
from .layout import PAGE_HEIGHT, flip_box, is_furniture, reading_order

#: Captions that say nothing, labels and how their texts are written.
PLAIN_CAPTIONS = ["image", "picture", "figure", "bild", "abbildung", "grafik", "foto"]
TEXT_FORMS = {"title": "\n# %s\n", "document_title": "\n# %s\n", "section_header": "\n## %s\n", "section-header": "\n## %s\n", "subtitle": "\n### %s\n", "caption": "\n*%s*\n", "footnote": "\n[^]: %s\n"}
HEADINGS = ["section_header", "title", "section-header"]


def elements(layouts: DataFrame) -> DataFrame:
    """One row an element of ``layouts`` (doc_id, texts, tables, pictures, groups arrays of structs): doc_id, ref, kind, item and the struct's fields.

    Each struct has self_ref, parent, label, content_layer, text, marker, page_no, bbox, children (references in order).
    """
    out = None
    for kind in ("texts", "tables", "pictures", "groups"):
        one = layouts.select("doc_id", F.posexplode(kind).alias("item", "e")).select("doc_id", "item", F.lit(kind).alias("kind"), "e.*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.withColumnRenamed("self_ref", "ref")


def resolved(references: DataFrame, items: DataFrame) -> DataFrame:
    """``references`` (doc_id, ref) with the elements they name; nulls where there is none."""
    return references.join(items, ["doc_id", "ref"], "left")


def with_metadata(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """``items`` (doc_id, ref, …) with the metadata of their reference, else of the index at its end.

    ``metadata``: doc_id, self_ref, ord and any columns.
    """
    columns = [c for c in metadata.columns if c not in ("doc_id", "self_ref", "ord")]
    named = metadata.where("self_ref is not null").dropDuplicates(["doc_id", "self_ref"]).select("doc_id", F.col("self_ref").alias("ref"), F.struct(*columns).alias("__by_ref"))
    placed = metadata.select("doc_id", F.col("ord").alias("__index"), F.struct(*columns).alias("__by_index"))
    index = F.regexp_extract("ref", r"(\d+)$", 1).cast("int")
    out = items.join(named, ["doc_id", "ref"], "left").withColumn("__index", index).join(placed, ["doc_id", "__index"], "left")
    best = F.coalesce("__by_ref", "__by_index")
    return out.select(*items.columns, *[best[c].alias(c) for c in columns])


def walk(layouts: DataFrame, items: DataFrame, skipped_tables: DataFrame | None = None) -> DataFrame:
    """``items`` that are shown, with ``place``: their path of positions from the body down.

    ``layouts``: doc_id, body (references in order).  Texts inside pictures, furniture and ``skipped_tables`` (doc_id, ref)
    go with all below them; captions below anything but a group are shown with their owner.  Paths double their reach
    with each join, so elements may lie at any depth; an element that is below itself is an error.
    """
    shown = items.where(~is_furniture(F.col("label"), F.col("content_layer")) & ~((F.col("kind") == "texts") & F.coalesce(F.col("parent").contains("/pictures/"), F.lit(False))))
    if skipped_tables is not None:
        shown = shown.join(skipped_tables.select("doc_id", "ref"), ["doc_id", "ref"], "left_anti")
    top = layouts.select("doc_id", F.posexplode("body").alias("at", "ref"), F.lit(None).cast("string").alias("up"), F.lit("groups").alias("__owner"))
    below = shown.select("doc_id", F.posexplode("children").alias("at", "child"), F.col("ref").alias("up"), F.col("kind").alias("__owner"))
    listed = top.unionByName(below.withColumnRenamed("child", "ref")).join(shown.select("doc_id", "ref", "label"), ["doc_id", "ref"])
    listed = listed.where((F.col("__owner") == "groups") | (F.coalesce(F.lower("label"), F.lit("")) != "caption"))
    links = listed.select("doc_id", F.col("ref").alias("node"), "up", F.array("at").alias("place"))
    return root_paths(links, ["doc_id"], ["place"], on_cycle="error").withColumnRenamed("node", "ref").join(shown, ["doc_id", "ref"])


def _text_form(label: Column, text: Column, marker: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    out = F.when(low == "list_item", F.concat_ws(" ", F.coalesce(marker, F.lit("-")), text))
    for name, form in TEXT_FORMS.items():
        out = out.when(low == name, F.format_string(form, text))
    return out.otherwise(F.format_string("\n%s\n", text))


def to_markdown(shown: DataFrame, captions: DataFrame) -> DataFrame:
    """doc_id, markdown of elements in order: a mark where the page rises, texts by label, tables and pictures with their images.

    ``shown``: doc_id, ref, kind, place, label, text, marker, page_no, img_path and html (tables), filename and caption
    (pictures).  ``captions``: doc_id, ref, caption of the layout itself.
    """
    rows = shown.join(captions.select("doc_id", "ref", F.col("caption").alias("__caption")), ["doc_id", "ref"], "left")
    order = Window.partitionBy("doc_id").orderBy("place")
    number = F.count_if(F.col("kind") == "pictures").over(order.rowsBetween(Window.unboundedPreceding, 0))
    speaks = ((F.col("kind") == "texts") & (F.coalesce("text", F.lit("")) != "")) | F.col("kind").isin("tables", "pictures")
    page = F.coalesce("page_no", F.lit(1))
    top = F.coalesce(F.max(F.when(speaks, page)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mark = F.when(speaks & (page > top), F.format_string('\n<seite nummer="%d" />\n', page))
    own = F.nullif("__caption", F.lit(""))
    html, image = F.nullif("html", F.lit("")), F.nullif("img_path", F.lit(""))
    inside = F.coalesce(F.concat(F.lit("\n<caption_text>"), own, F.lit("</caption_text>")), F.lit(""))
    body = F.concat(inside, F.coalesce(F.concat(F.lit("\n"), html), F.lit("")), F.lit("\n</TABELLE>\n"))
    opened = F.when(image.isNotNull(), F.format_string('\n<TABELLE img_path="images/%s">', image)).when(html.isNotNull(), F.lit("\n<TABELLE>"))
    table = F.array(F.concat(F.lit("\n"), own, F.lit("\n")), F.concat(opened, body))
    said = F.coalesce(own, F.nullif("caption", F.lit("")))
    low = F.lower(strip(said))
    plain = F.lit(False)
    for word in PLAIN_CAPTIONS:
        plain = plain | (low == word) | low.startswith(word + " ")
    alt = F.when(said.isNull() | plain, F.format_string("Image %d", number)).otherwise(said)
    picture = F.array(F.when(F.coalesce("filename", F.lit("")) != "", F.format_string("\n![%s](images/%s)\n", alt, F.col("filename"))))
    text = F.array(F.when(speaks, _text_form(F.col("label"), F.col("text"), F.col("marker"))))
    parts = F.when(F.col("kind") == "texts", text).when(F.col("kind") == "tables", table).when(F.col("kind") == "pictures", picture)
    rows = rows.select("doc_id", "place", F.array_compact(F.concat(F.array(mark), F.coalesce(parts, F.array().cast("array<string>")))).alias("parts"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "parts"))), lambda x: x["parts"])
    return rows.groupBy("doc_id").agg(F.array_join(F.flatten(listed), "\n").alias("markdown"))


def content_list(items: DataFrame, heights: DataFrame) -> DataFrame:
    """doc_id, pos, type, text, text_level, table_body, img_path, page (0-based), label, bbox (from the top left) in reading order.

    ``items``: doc_id, kind, item, label, content_layer, text, page_no, bbox (from the bottom left), html, img_path, filename;
    ``heights``: doc_id, page_no, height.  Texts of furniture and blank ones are left out.
    """
    height = F.coalesce("height", F.lit(PAGE_HEIGHT))
    rows = items.where(F.col("kind").isin("texts", "tables", "pictures")).withColumn("page_no", F.coalesce("page_no", F.lit(1)))
    rows = rows.where((F.col("kind") != "texts") | (~is_furniture(F.col("label"), F.col("content_layer")) & (F.coalesce("text", F.lit("")) != "")))
    rows = rows.join(heights, ["doc_id", "page_no"], "left")
    kind = F.when(F.col("kind") == "texts", "text").when(F.col("kind") == "tables", "table").otherwise("image")
    image = F.when(F.col("kind") == "tables", F.col("img_path")).when(F.col("kind") == "pictures", F.col("filename"))
    rows = rows.select(
        "doc_id",
        "item",
        kind.alias("type"),
        F.when(F.col("kind") == "texts", F.col("text")).alias("text"),
        F.when((F.col("kind") == "texts") & F.col("label").isin(HEADINGS), 1).alias("text_level"),
        F.when(F.col("kind") == "tables", F.coalesce("html", F.lit(""))).alias("table_body"),
        F.concat(F.lit("images/"), F.nullif(image, F.lit(""))).alias("img_path"),
        (F.col("page_no") - 1).alias("page"),
        F.when(F.col("kind") == "tables", "table").otherwise(F.coalesce("label", F.when(F.col("kind") == "texts", "text").otherwise("picture"))).alias("label"),
        F.when(F.col("bbox").isNotNull(), flip_box(F.col("bbox"), height)).alias("bbox"),
    )
    return reading_order(rows).drop("item")


def crop_boxes(tables: DataFrame, *, padding: int = 5) -> DataFrame:
    """Adds left, top, right, bottom in pixels of each table without an image of its own on its page's image.

    ``tables``: bbox (from the top left, in points), page_width, page_height, image_width, image_height.
    """
    x, y = F.col("image_width") / F.col("page_width"), F.col("image_height") / F.col("page_height")
    side = lambda i, scale: (F.get("bbox", F.lit(i)) * scale).cast("int")
    return (
        tables.withColumn("left", F.greatest(F.lit(0), side(0, x) - padding))
        .withColumn("top", F.greatest(F.lit(0), side(1, y) - padding))
        .withColumn("right", F.least(F.col("image_width"), side(2, x) + padding))
        .withColumn("bottom", F.least(F.col("image_height"), side(3, y) + padding))
    )


def embedded_image(uri: Column) -> Column:
    """The bytes of a base64 data address, null for other addresses."""
    return F.when(uri.rlike(r"^data:image/[^;,]+;base64,"), F.unbase64(F.regexp_extract(uri, r"(?s)^[^,]*,(.*)$", 1)))
