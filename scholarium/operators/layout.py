"""Figures of laid-out pages, and the best attachment of an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarium.functions import text as tx

# Fixed value: how captions begin.
CAPTION = r"^\s*(?:Figure|Fig\.?|图)\s*(\d+)"


def _line_text(lines: Column) -> Column:
    none = F.array().cast("array<struct<spans:array<struct<content:string>>>>")
    return F.array_join(F.flatten(F.transform(F.coalesce(lines, none), lambda line: F.transform(line["spans"], lambda s: F.coalesce(s["content"], F.lit(""))))), "")


def span_text(block: Column) -> Column:
    """The text of a block's inner blocks, or of its own lines if these have none."""
    inner = F.array_join(F.transform(F.coalesce(block["blocks"], F.array().cast("array<struct<type:string,bbox:array<double>,lines:array<struct<spans:array<struct<content:string>>>>>>")), lambda b: _line_text(b["lines"])), "")
    return F.when(inner != "", inner).otherwise(_line_text(block["lines"]))


def block_caption(block: Column) -> Column:
    """The text of a block that begins like a caption, else the first of its inner captions that does, else null."""
    captions = F.filter(F.coalesce(block["blocks"], F.array().cast("array<struct<type:string,bbox:array<double>,lines:array<struct<spans:array<struct<content:string>>>>>>")), lambda b: b["type"] == "image_caption")
    texts = F.filter(F.transform(captions, lambda b: _line_text(b["lines"])), lambda t: t.rlike(CAPTION))
    own = span_text(block)
    return F.when(own.rlike(CAPTION), own).otherwise(F.get(texts, F.lit(0)))


def flat_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of scholarium.sources.tables.layout_blocks with box, text and caption as columns."""
    box = lambda i: F.get("block.bbox", F.lit(i))
    return blocks.select("doc", "page_idx", "page_w", "page_h", "ord", F.col("block.type").alias("type"), box(0).alias("x0"), box(1).alias("y0"), box(2).alias("x1"), box(3).alias("y1"), span_text(F.col("block")).alias("text"), block_caption(F.col("block")).alias("caption"))


def figure_boxes(blocks: DataFrame, pdf_pages: DataFrame | None = None) -> DataFrame:
    """(doc, page_idx, x0, y0, x1, y1, caption, num): blocks of images, charts and tables, joined down the page unless
    the gap to the one before is over 15 % of its height. Blocks of one place (y0, ord, y1) are in one group. The page's first
    caption goes to its first group.

    blocks: doc, page_idx, page_w, page_h, ord, type, x0, y0, x1, y1, text, and caption, where captions of inner blocks
    count too (without it, texts that begin like one do). With pdf_pages (doc, page_idx, pdf_w, pdf_h)
    boxes are scaled to the PDF's pages, widened by 3 and held inside them.
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    on_page = Window.partitionBy("doc", "page_idx").orderBy("y0", "ord", "y1")
    seen = blocks.where(F.col("type").isin("image", "chart", "table") & (area >= 2500))
    apart = F.col("y0") - F.lag("y1").over(on_page) > F.col("page_h") * 0.15
    groups = seen.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("gi", F.sum("_new").over(on_page))
    boxes = groups.groupBy("doc", "page_idx", "gi").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"))
    caption = F.col("caption") if "caption" in blocks.columns else F.when(F.col("text").rlike(CAPTION), F.col("text"))
    captions = blocks.withColumn("_c", caption).where("_c is not null").groupBy("doc", "page_idx").agg(F.substring(F.min_by("_c", "ord"), 1, 150).alias("_caption"))
    boxes = boxes.join(captions, ["doc", "page_idx"], "left").withColumn("caption", F.when(F.col("gi") == 0, F.coalesce("_caption", F.lit(""))).otherwise("")).where(area >= 8000)
    if pdf_pages is not None:
        of = pdf_pages.select(F.col("doc").alias("_doc"), F.col("page_idx").alias("_page"), "pdf_w", "pdf_h")
        boxes = boxes.join(of, F.col("doc").eqNullSafe(F.col("_doc")) & F.col("page_idx").eqNullSafe(F.col("_page")))
        sx, sy = F.col("pdf_w") / F.col("page_w"), F.col("pdf_h") / F.col("page_h")
        boxes = boxes.withColumns({"x0": F.greatest(F.lit(0.0), F.col("x0") * sx - 3), "y0": F.greatest(F.lit(0.0), F.col("y0") * sy - 3), "x1": F.least(F.col("pdf_w"), F.col("x1") * sx + 3), "y1": F.least(F.col("pdf_h"), F.col("y1") * sy + 3)})
    numbered = boxes.withColumn("num", F.row_number().over(Window.partitionBy("doc").orderBy("page_idx", "gi")))
    return numbered.select("doc", "page_idx", "x0", "y0", "x1", "y1", "caption", "num")


def attachment_candidates(children: DataFrame, files: DataFrame) -> DataFrame:
    """(item, pos, path, att_key, title, size): the PDF files of each item's PDF attachments, in the order of the
    attachments, then of the file names.

    children: item, ord, att_key, item_type, content_type, title. files: path, size, att_key (sources.tables.attachments).
    """
    wanted = children.where((F.col("item_type") == "attachment") & (F.col("content_type") == "application/pdf"))
    pdfs = files.where(F.lower("path").endswith(".pdf"))
    joined = wanted.join(pdfs, "att_key")
    place = F.row_number().over(Window.partitionBy("item").orderBy("ord", "path")) - 1
    return joined.select("item", place.alias("pos"), "path", "att_key", "title", "size")


def best_attachment(candidates: DataFrame) -> DataFrame:
    """(item, path, att_key): a full text that is no supplement, else anything that is none, else anything; then the
    largest, then the first. candidates: item, pos, path, att_key, title, size."""
    supplement = tx.is_supplement_name(tx.file_name(F.col("path"))) | tx.is_supplement_title(F.col("title"))
    tier = F.when(~supplement & tx.is_full_text_title(F.col("title")), 2).when(~supplement, 1).otherwise(0)
    pdfs = candidates.where(F.lower("path").endswith(".pdf"))
    best = pdfs.groupBy("item").agg(F.max_by(F.struct("path", "att_key"), F.struct(tier.alias("t"), F.coalesce("size", F.lit(0)).alias("s"), -F.col("pos"))).alias("b"))
    return best.select("item", "b.path", "b.att_key")
