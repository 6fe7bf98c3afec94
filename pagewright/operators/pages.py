"""Whole pages: from glyphs to lines in reading order with the document's body style and labels.

The operators of ``layout`` in the order in which they need each other. The lines and the body
style are written once, as several labels read them. Every document has its own body height and
fonts; labels use them through the column ``body_height``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import predicates as P
from pagewright.operators import front_matter, layout
from pagewright.session import drop_table, write_table
from pagewright.sources.layouts import PAGE, PAGE_HEIGHT, PAGE_WIDTH


def clustered(glyphs: DataFrame, *, page_width: float = PAGE_WIDTH) -> DataFrame:
    """The good glyphs of each page with the line (``k``, by document) and visual row that they belong to."""
    good = front_matter.admitted(glyphs).where("reason is null")
    items = good.select(*PAGE, F.col("offset").alias("i"), F.col("c").alias("text"), "x0", "y0", "x1", "y1", (F.col("y1") - F.col("y0")).alias("h"), "font", F.coalesce("break_after", F.lit(False)).alias("break_after"))
    row = [*PAGE, "visual_row"]
    cut = layout.split_rows(layout.cluster_rows(items, rule="layout"), row=row, page_width=page_width)
    named = cut.select(*row, "segment").distinct().withColumn("k", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "visual_row", "segment")) - 1).cast("long"))
    return cut.join(named, [*row, "segment"]).drop("segment").withColumnRenamed("visual_row", "row")


def lines_of(items: DataFrame) -> DataFrame:
    """The lines of ``clustered`` items: text, sides, height, and whether their baselines differ."""
    line = [*PAGE, "row", "k"]
    texts = layout.line_texts(items, line=line).where("text <> ''")
    height = F.median("h")
    boxes = items.groupBy(*line).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), height.alias("h"), (F.max("y1") - F.min("y1") > height * 0.35).alias("multi_baseline"))
    return texts.join(boxes, line)


def body_style(lines: DataFrame, items: DataFrame, *, page_width: float = PAGE_WIDTH, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """``lines`` with body_height, primary_font and body_font_fraction.

    A document without a line that tells its body height has the median of its lines' heights.
    """
    told = layout.body_heights(lines, keys=["doc_id"], page_width=page_width, page_height=page_height).where("rank = 1").select("doc_id", F.col("height").alias("told"))
    usual = lines.groupBy("doc_id").agg(layout.median_mean(F.col("h")).alias("usual"))
    heights = usual.join(told, "doc_id", "left").select("doc_id", F.coalesce("told", F.when(F.col("usual") > 0, F.col("usual")), F.lit(1.0)).alias("body_height"))
    styled = lines.join(heights, "doc_id")
    of_lines = items.drop("h").join(styled.select("doc_id", "k", "h", "body_height"), ["doc_id", "k"])
    fonts = layout.body_fonts(of_lines, keys=["doc_id"])
    return styled.join(layout.font_shares(of_lines, fonts, keys=["doc_id"], line=["doc_id", "k"]), ["doc_id", "k"])


def edge_labels(lines: DataFrame, *, page_height: float = PAGE_HEIGHT, compose: bool = True) -> DataFrame:
    """K and reason of page numbers and of edge lines that enough pages of the document share."""
    top, bottom = F.col("y0") / page_height < layout.EDGE, F.col("y1") / page_height > 1 - layout.EDGE
    edge = lines.where(top | bottom).select("doc_id", "k", F.when(top, "top").otherwise("bottom").alias("edge"), layout.T.edge_key(F.col("text"), compose).alias("key"), P.page_number(F.col("text"), compose).alias("number"))
    shared = layout.repeated_edges(lines, keys=["doc_id"], units="page", page_height=page_height, compose=compose).withColumn("shared", F.lit(True))
    marked = edge.join(shared, ["doc_id", "edge", "key"], "left")
    reason = F.when(F.col("number"), "page-number").when(F.col("shared"), F.when(F.col("edge") == "top", "repeated-header").otherwise("repeated-footer"))
    return marked.select("doc_id", "k", reason.alias("reason")).where("reason is not null")


def _first_label(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``lines`` where those without a reason take the one in ``found`` (doc_id, k, reason)."""
    new = found.groupBy("doc_id", "k").agg(F.min("reason").alias("new_reason"))
    return lines.join(new, ["doc_id", "k"], "left").withColumn("reason", F.coalesce("reason", "new_reason")).drop("new_reason")


def ordered_pages(glyphs: DataFrame, *, page_width: float = PAGE_WIDTH, page_height: float = PAGE_HEIGHT, compose: bool = True) -> DataFrame:
    """All lines of all pages in reading order, each with the first reason to leave it out.

    Reasons are given in this order: page-number, repeated-header or repeated-footer,
    display-formula, table-content, table-caption or figure-caption, figure-label, footnote,
    publisher-metadata. Lines that the edges took do not count in gutters and tables.
    """
    items = write_table(clustered(glyphs, page_width=page_width), "page-items")
    plain = write_table(lines_of(items), "page-lines")
    styled = body_style(plain, items, page_width=page_width, page_height=page_height).withColumn("reason", F.lit(None).cast("string"))
    lines = write_table(_first_label(styled, edge_labels(plain, page_height=page_height, compose=compose)), "styled-lines")
    gutter = layout.gutters(lines.where("reason is null"), page_width=page_width, page_height=page_height)
    ordered = layout.reading_order(lines, gutter, layout.page_bands(lines, page_height=page_height), page_width=page_width)
    at = Window.partitionBy("doc_id").orderBy("page", "order_index")
    first = F.row_number().over(at) > 1
    ordered = ordered.withColumn("transition", F.when((F.col("order_index") == 0) & first, "page-break").otherwise(F.col("transition")))
    ordered = write_table(ordered, "ordered-lines")
    drop_table(items, plain, lines)
    flow = [*PAGE, "flow_key"]
    free = ordered.where("reason is null")
    formulas = layout.formula_regions(free, flow=flow, compose=compose).select("doc_id", "k", F.lit("display-formula").alias("reason"))
    out = write_table(_first_label(ordered, formulas), "formula-lines")
    drop_table(ordered)
    free = out.where("reason is null")
    rows = layout.table_runs(free, flow=flow, compose=compose).select(*flow, "row")
    tables = free.join(rows, [*flow, "row"], "left_semi").select("doc_id", "k", F.lit("table-content").alias("reason"))
    formulas, out = out, write_table(_first_label(out, tables), "table-lines")
    drop_table(formulas)
    out = _first_label(out, layout.captions_and_labels(out).select("doc_id", "k", "reason"))
    text = F.col("text")
    foot = P.footnote(text, font_height=F.col("h"), body_height=F.col("body_height"), bottom_ratio=F.col("y1") / page_height, width_ratio=(F.col("x1") - F.col("x0")) / page_width, compose=compose)
    publisher = P.publisher_metadata(text, font_height=F.col("h"), body_height=F.col("body_height"), top_ratio=F.col("y0") / page_height, bottom_ratio=F.col("y1") / page_height, compose=compose)
    return out.withColumn("reason", F.coalesce("reason", F.when(foot, "footnote").when(publisher, "publisher-metadata")))


def body_heights_of(lines: DataFrame) -> DataFrame:
    """doc_id and body_height of ``ordered_pages`` lines."""
    return lines.groupBy("doc_id").agg(F.first("body_height").alias("body_height"))


def extract(glyphs: DataFrame, *, page_width: float = PAGE_WIDTH, page_height: float = PAGE_HEIGHT) -> dict[str, DataFrame]:
    """The ordered lines under 'pages', and what ``front_matter.extract`` finds with each document's own body height."""
    pages = write_table(ordered_pages(glyphs, page_width=page_width, page_height=page_height), "pages")
    front = front_matter.front_lines(glyphs, page_width=page_width, page_height=page_height, heights=body_heights_of(pages))
    return {"pages": pages} | front_matter.extract(front, page_width=page_width, page_height=page_height)
