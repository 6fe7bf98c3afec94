"""Sources: positioned glyph tables, metadata lookups, and a layout derived from plain text.

``text_lines`` and ``line_items`` lay plain documents out on pages of 600 by 800 in two
columns of 40 rows, so that layout operators can run over any corpus. The same rule can be
written in SQL (``LINES_SQL``, ``ITEMS_SQL``), which is what the oracle queries build on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry as G

PAGE_WIDTH, PAGE_HEIGHT, BODY_HEIGHT = 600.0, 800.0, 10.0
WRAP, ROWS = 48, 40
PAGE = ["doc_id", "page"]


def scan_glyphs(spark: SparkSession, path: str, pages: list[int] | None = None) -> DataFrame:
    """A Parquet table of glyphs, only the asked pages (the filter reaches the scan)."""
    glyphs = spark.read.parquet(path)
    return glyphs.where(F.col("page").isin(sorted({int(p) for p in pages}))) if pages is not None else glyphs


def page_diagnostics(glyphs: DataFrame, m: Column) -> DataFrame:
    """For each page the glyphs with a usable rectangle, those without, the largest round-trip error and whether coordinates hold."""
    good = G.rect_normalize(F.col("rect"))
    back = G.transform_rect(G.inverse(m), G.transform_rect(m, good))
    error = F.greatest(*[F.abs(good[s] - back[s]) for s in G.SIDES])
    out = glyphs.groupBy(*PAGE).agg(F.count_if(good.isNotNull()).alias("glyphs"), F.count_if(good.isNull()).alias("invalid"), F.max(error).alias("max_error"))
    return out.withColumn("coordinate_valid", (F.col("glyphs") >= 1) & (F.coalesce("max_error", F.lit(0.0)) <= 0.5))


def first_source(sources: list[DataFrame], key: list[str], value: str) -> DataFrame:
    """S3: for each key the value of the first source that has one."""
    ranked = reduce(DataFrame.unionByName, [s.select(*key, value, F.lit(i).alias("source_rank")) for i, s in enumerate(sources)])
    return ranked.where(F.col(value).isNotNull()).groupBy(*key).agg(F.min_by(value, "source_rank").alias(value))


def metadata(attachments: DataFrame, items: DataFrame) -> DataFrame:
    """Title and abstract of each attachment's parent item, empty where absent."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    parent = items.select(F.col("item_id").alias("parent_id"), text("title").alias("title"), text("abstract").alias("abstract"))
    return attachments.join(parent, "parent_id", "left").withColumns({"title": F.coalesce("title", F.lit("")), "abstract": F.coalesce("abstract", F.lit(""))})


def text_lines(docs: DataFrame) -> DataFrame:
    """Visual lines of every document: doc_id, k, page, col, row, text, x0, y0, x1, y1, h."""
    paragraphs = F.split(F.coalesce("text", F.lit("")), "\n")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(p) / WRAP) - 1, F.lit(0)).cast("int")), lambda i: F.substring(p, i * WRAP + 1, F.lit(WRAP)))))
    lines = docs.select("doc_id", F.posexplode(pieces).alias("k", "text")).where("text <> ''").withColumn("k", F.col("k").cast("long"))
    k, row, col = F.col("k"), F.col("row"), F.col("col")
    lines = lines.withColumns({"page": F.floor(k / (2 * ROWS)).cast("long"), "col": F.floor(F.pmod(k, F.lit(2 * ROWS)) / ROWS).cast("long"), "row": F.pmod(k, F.lit(ROWS)).cast("long")})
    spaces = F.char_length("text") - F.char_length(F.translate("text", " ", ""))
    width = F.when((col == 0) & row.isin(0, 20), F.lit(520.0)).otherwise(5.0 * (F.char_length("text") - spaces) + 3.0 * spaces)
    lines = lines.withColumns({"x0": F.when(col == 0, F.lit(40.0)).otherwise(F.lit(320.0)), "y0": 25.0 + 16.0 * row + F.when(row >= 20, 40.0).otherwise(F.lit(0.0)), "h": F.when(k == 0, 20.0).when(k % 11 == 5, 12.0).when(k % 13 == 7, 8.0).otherwise(F.lit(10.0))})
    return lines.withColumns({"x1": F.col("x0") + width, "y1": F.col("y0") + F.col("h")}).select("doc_id", "k", "page", "col", "row", "text", "x0", "y0", "x1", "y1", "h")


def line_items(lines: DataFrame) -> DataFrame:
    """Words of each line as glyph items: doc_id, page, k, i, text, x0, y0, x1, y1, h, font, break_after.

    A word that ends a sentence is followed by a gap of 30; upper-case words have a font of
    their own.
    """
    words = F.filter(F.split("text", " "), lambda w: w != "")
    wide = lambda w: 5.0 * F.char_length(w)
    step = lambda w: wide(w) + F.when(w.rlike(r"[.]$"), 30.0).otherwise(F.lit(3.0))
    lefts = F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.aggregate(F.slice("words", F.lit(1), i - 1), F.lit(0.0), lambda a, w: a + step(w)))
    items = lines.withColumn("words", words).where(F.size("words") > 0).select("doc_id", "page", "k", "x0", "y0", "y1", "h", F.posexplode(F.arrays_zip(F.col("words").alias("w"), lefts.alias("left"))).alias("i", "item"), (F.size("words") - 1).alias("last"))
    left = F.col("x0") + F.col("item.left")
    return items.select("doc_id", "page", "k", F.col("i").cast("long").alias("i"), F.col("item.w").alias("text"), left.alias("x0"), "y0", (left + wide(F.col("item.w"))).alias("x1"), "y1", "h", F.when(F.col("item.w").rlike("^[A-Z]"), "caps").otherwise("plain").alias("font"), (F.col("i") == F.col("last")).alias("break_after"))


LINES_SQL = """lines0 AS (
  SELECT doc_id, unnest(pieces) AS text, generate_subscripts(pieces, 1) - 1 AS k FROM (
    SELECT doc_id, flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: list_transform(range(0, greatest(CAST(ceil(length(p) / 48.0) AS BIGINT), 1)), lambda i: substr(p, i * 48 + 1, 48)))) AS pieces FROM documents)
), lines1 AS (
  SELECT doc_id, text, CAST(k AS BIGINT) AS k, CAST(k // 80 AS BIGINT) AS page, CAST((k % 80) // 40 AS BIGINT) AS col, CAST(k % 40 AS BIGINT) AS row, length(text) - length(replace(text, ' ', '')) AS spaces FROM lines0 WHERE text <> ''
), lines2 AS (
  SELECT *, CASE WHEN col = 0 THEN 40.0::DOUBLE ELSE 320.0::DOUBLE END AS x0, 25.0::DOUBLE + 16 * row + CASE WHEN row >= 20 THEN 40 ELSE 0 END AS y0,
    CASE WHEN k = 0 THEN 20.0::DOUBLE WHEN k % 11 = 5 THEN 12.0::DOUBLE WHEN k % 13 = 7 THEN 8.0::DOUBLE ELSE 10.0::DOUBLE END AS h,
    CASE WHEN col = 0 AND row IN (0, 20) THEN 520.0::DOUBLE ELSE 5.0::DOUBLE * (length(text) - spaces) + 3 * spaces END AS width FROM lines1
), lines AS (
  SELECT doc_id, k, page, col, row, text, x0, y0, x0 + width AS x1, y0 + h AS y1, h FROM lines2
)"""

ITEMS_SQL = """items0 AS (
  SELECT doc_id, page, k, x0, y0, y1, h, unnest(words) AS text, generate_subscripts(words, 1) - 1 AS i, len(words) - 1 AS last FROM (
    SELECT *, list_filter(string_split(text, ' '), lambda w: w <> '') AS words FROM lines)
), items1 AS (
  SELECT *, x0 + coalesce(sum(5.0::DOUBLE * length(text) + CASE WHEN text LIKE '%.' THEN 30 ELSE 3 END) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM items0
), items AS (
  SELECT doc_id, page, k, CAST(i AS BIGINT) AS i, text, l AS x0, y0, l + 5 * length(text) AS x1, y1, h, CASE WHEN regexp_matches(text, '^[A-Z]') THEN 'caps' ELSE 'plain' END AS font, i = last AS break_after FROM items1
)"""
