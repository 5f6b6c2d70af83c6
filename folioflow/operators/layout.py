"""Layout elements: page furniture, recurring elements, order, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import digit_free, strip
from ..plans.staging import stage

#: Labels of furniture and the zones of a page, as shares of its height.
FURNITURE = ["page_header", "page_footer", "page-header", "page-footer"]
HEADER_SHARE, FOOTER_SHARE, PAGE_HEIGHT = 0.12, 0.18, 842.0


def is_furniture(label: Column, layer: Column) -> Column:
    return F.coalesce(F.lower(label).isin(FURNITURE) | (F.lower(layer) == "furniture"), F.lit(False))


def in_margin(bbox: Column, height: float = PAGE_HEIGHT) -> Column:
    """Whether a box (x0, y0, x1, y1 from the top left) lies in the header or footer zone."""
    return F.coalesce((F.get(bbox, F.lit(3)) < height * HEADER_SHARE) | (F.get(bbox, F.lit(1)) > height * (1 - FOOTER_SHARE)), F.lit(False))


def recurring(items: DataFrame, *, threshold: int = 2, double_count_zone_images: bool = False) -> DataFrame:
    """doc_id, item of elements that repeat an earlier one of the document.

    Signatures: a table's trimmed HTML, a text as it is and without digits, an image's hash; texts and tables
    count in the margins only.  The first of a group (by page, then height) stays.
    """
    margin = in_margin(F.col("bbox"))
    kinds = [
        (items.where((F.col("type") == "table") & margin), strip(F.col("table_body")), "table"),
        (items.where((F.col("type") == "text") & margin), strip(F.col("text")), "text"),
        (items.where((F.col("type") == "text") & margin & (digit_free(F.col("text")) != strip(F.col("text")))), digit_free(F.col("text")), "digits"),
        (items.where(F.col("type") == "image"), F.col("phash").cast("string"), "image"),
    ]
    signed = None
    for rows, signature, kind in kinds:
        one = rows.select("doc_id", "item", "page", F.get("bbox", F.lit(1)).alias("y0"), F.lit(kind).alias("kind"), signature.alias("sig"))
        signed = one if signed is None else signed.unionByName(one)
    signed = signed.where((F.col("sig") != "") & F.col("sig").isNotNull())
    group = Window.partitionBy("doc_id", "kind", "sig")
    ranked = signed.withColumn("n", F.count("*").over(group)).withColumn("rn", F.row_number().over(group.orderBy("page", "y0", "item")))
    gone = ranked.where((F.col("n") >= threshold) & (F.col("rn") > 1)).select("doc_id", "item")
    if double_count_zone_images:
        gone = gone.unionByName(items.where((F.col("type") == "image") & margin).select("doc_id", "item"))
    return gone.distinct()


def reading_order(items: DataFrame) -> DataFrame:
    """Adds ``pos``: by page, then height, then kind (texts, tables, pictures), then index."""
    kind = F.when(F.col("type") == "text", 0).when(F.col("type") == "table", 1).otherwise(2)
    w = Window.partitionBy("doc_id").orderBy("page", F.coalesce(F.get("bbox", F.lit(1)), F.lit(0.0)), kind, "item")
    return items.withColumn("pos", F.row_number().over(w) - 1)


def flip_box(bbox: Column, height: Column) -> Column:
    """A box with its origin at the bottom left, seen from the top left."""
    return F.array(F.get(bbox, F.lit(0)), height - F.get(bbox, F.lit(3)), F.get(bbox, F.lit(2)), height - F.get(bbox, F.lit(1)))


def full_page_images(pages: DataFrame, items: DataFrame, threshold: float = 0.10) -> DataFrame:
    """doc_id, page of pages with an image, without pictures and tables, and hardly any text area."""
    busy = items.where(F.col("type").isin("image", "table")).select("doc_id", "page").distinct()
    area = (F.get("bbox", F.lit(2)) - F.get("bbox", F.lit(0))) * (F.get("bbox", F.lit(3)) - F.get("bbox", F.lit(1)))
    text = items.where("type = 'text'").groupBy("doc_id", "page").agg(F.sum(area).alias("area"))
    out = pages.where("has_image").join(busy, ["doc_id", "page"], "left_anti").join(text, ["doc_id", "page"], "left")
    return out.where(F.coalesce("area", F.lit(0.0)) / (F.col("width") * F.col("height")) < threshold).select("doc_id", "page")


def near_image_pairs(images: DataFrame, most: int = 8, bands: int = 9) -> DataFrame:
    """Pairs of one document whose 64-bit hashes differ in at most ``most`` bits.

    The hash is cut into ``most`` + 1 bands: two such hashes agree in one of them, which is the join key.
    """

    def band(i: int) -> Column:
        start, end = i * 64 // bands, (i + 1) * 64 // bands
        return F.shiftrightunsigned("phash", start).bitwiseAND((1 << (end - start)) - 1)

    cut = images.select("doc_id", "item", "phash", F.posexplode(F.array(*[band(i) for i in range(bands)])).alias("band", "value"))
    other = cut.select("doc_id", F.col("item").alias("other"), F.col("phash").alias("o"), "band", "value")
    pairs = cut.join(other, ["doc_id", "band", "value"]).where(F.col("item") < F.col("other"))
    return pairs.where(F.bit_count(F.col("phash").bitwiseXOR(F.col("o"))) <= most).select("doc_id", "item", "other").distinct()


def image_leaders(images: DataFrame, most: int = 8) -> DataFrame:
    """doc_id, item, leader: images of a document joined, in the order of ``item``, to the first leader that is near enough.

    An image leads if no earlier leader is within ``most`` bits.  Equal hashes share their first one's leader, so each
    distinct hash counts once.  Rounds decide all images at once: those without an undecided earlier near one lead, those
    near to them follow; a round is joins over the near pairs, so a document of any size is many tasks.  Rounds grow with
    the longest chain of near images, not with their number.  An image without a hash or a document leads itself alone.
    """
    known = images.where(F.col("phash").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "item", F.col("phash").cast("long").alias("phash"))
    firsts = stage(known.groupBy("doc_id", "phash").agg(F.min("item").alias("item")), "hashes")
    edges = stage(near_image_pairs(firsts, most, most + 1).select("doc_id", F.col("item").alias("early"), F.col("other").alias("late")), "near")
    live = edges
    open_ = stage(edges.select("doc_id", F.col("late").alias("item")).distinct(), "open")
    leads = stage(firsts.select("doc_id", "item").join(open_, ["doc_id", "item"], "left_anti"), "leads")
    found = leads
    while not open_.isEmpty():
        follow = live.join(leads.withColumnRenamed("item", "early"), ["doc_id", "early"], "left_semi").select("doc_id", F.col("late").alias("item")).distinct()
        open_ = stage(open_.join(follow, ["doc_id", "item"], "left_anti"), "open")
        # an edge counts while both its ends are open
        live = live.join(open_.withColumnRenamed("item", "early"), ["doc_id", "early"], "left_semi")
        live = stage(live.join(open_.withColumnRenamed("item", "late"), ["doc_id", "late"], "left_semi").select("doc_id", "early", "late"), "near")
        leads = stage(open_.join(live.select("doc_id", F.col("late").alias("item")).distinct(), ["doc_id", "item"], "left_anti"), "leads")
        open_ = stage(open_.join(leads, ["doc_id", "item"], "left_anti"), "open")
        found = found.unionByName(leads)
    joined = edges.join(found.withColumnRenamed("item", "early"), ["doc_id", "early"], "left_semi").groupBy("doc_id", "late").agg(F.min("early").alias("__first"))
    # a leader has no leader before it, so only followers have a first one
    led = firsts.join(joined.withColumnRenamed("late", "item"), ["doc_id", "item"], "left").select("doc_id", "phash", F.coalesce("__first", "item").alias("leader"))
    told = known.join(led, ["doc_id", "phash"]).select("doc_id", "item", "leader")
    return told.unionByName(images.where("phash is null or doc_id is null").select("doc_id", "item", F.col("item").alias("leader")))
