"""Known titles and abstracts as positioned targets on a document's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import predicates as P
from pagewright.functions import spans as S
from pagewright.operators import align
from pagewright.session import write_table

RESULT = ["doc_id", "kind", "text", "ks", "coverage", "matched", "confidence", "completeness", "boundary", "method"]


def _text_of(lines: DataFrame, picked: DataFrame) -> DataFrame:
    """``picked`` (doc_id, region, ks, ...) with the text of its lines in reading order as region_text."""
    ks = picked.select("doc_id", "region", F.explode("ks").alias("k")).join(lines.select("doc_id", "k", "page", "y0", "x0", F.col("text").alias("line_text")), ["doc_id", "k"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "y0", "x0", "k", "line_text"))), lambda x: x["line_text"]), " ")
    return picked.join(ks.groupBy("doc_id", "region").agg(text.alias("region_text")), ["doc_id", "region"])


def _shaped(df: DataFrame, kind: str) -> DataFrame:
    have = set(df.columns)
    empty = {"completeness": F.lit(None).cast("string"), "boundary": F.lit(None).cast("string")}
    return df.withColumn("kind", F.lit(kind)).select(*[F.col(c) if c in have or c == "kind" else empty[c].alias(c) for c in RESULT])


def title_targets(found: dict[str, DataFrame], metadata: DataFrame) -> DataFrame:
    """The title's lines: searched above the abstract or the body, then on the first two pages, else the best candidate of score 6 or more."""
    lines = found["lines"].where("reason is null and page <= 1")
    heading = found["lines"].join(found["abstract"].where("role = 'heading'").select("doc_id", "k"), ["doc_id", "k"]).select("doc_id", F.struct("page", "y0").alias("head_at"))
    cut = lines.join(heading, "doc_id", "left").join(found["body_start"].select("doc_id", F.struct("page", "y0").alias("body_at")), "doc_id", "left").withColumn("cut", F.coalesce("head_at", "body_at"))
    above = F.col("cut").isNull() | (F.struct("page", "y0") < F.col("cut"))
    named = cut.withColumn("region", F.explode(F.filter(F.array(F.when(above, 0), F.lit(1)), lambda x: x.isNotNull())))
    index = align.region_index(named, keys=["doc_id", "region"])
    anchored = align.passage_anchors(metadata.where("title <> ''"), kind="title", id_col="doc_id", text_col="title")
    hits = align.locate_in_region(index, anchored, on=["doc_id"], kind="title")
    best = hits.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("region"))).where("nth = 1").drop("nth")
    best = write_table(best, "title-hits")
    located = _text_of(lines, best).withColumns({"text": F.col("region_text"), "method": F.lit("metadata-segmented")})
    located = _shaped(located, "title")
    spare = found["titles"].where("rank = 1 and score >= 6").join(located.select("doc_id"), "doc_id", "left_anti")
    spare = spare.select("doc_id", "text", "ks", F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("matched"), "confidence", F.lit("layout-fallback").alias("method"))
    return located.unionByName(_shaped(spare, "title"))


def abstract_targets(found: dict[str, DataFrame], metadata: DataFrame) -> DataFrame:
    """M5-M8: the abstract's lines below its heading, else in one of the first page's columns.

    A region is verified by all its anchors, or inferred from word coverage and a reliable
    boundary; two regions as good as each other are refused. The lines between the first and last
    anchor are kept when the passage's tail is matched, else the region runs to its boundary.
    """
    tail = (F.col("reason") == "publisher-metadata") & F.col("kept_text").isNotNull()
    lines = found["lines"].where(P.included(F.col("reason")) | tail).withColumn("text", F.when(tail, F.col("kept_text")).otherwise(F.col("text")))
    body = lines.join(found["abstract"].where("role = 'body'").select("doc_id", "k", "boundary"), ["doc_id", "k"]).withColumn("region", F.lit(0))
    first = lines.where(P.included(F.col("reason"))).where("page = 0 and not is_abstract").withColumn("boundary", F.lit(None).cast("string"))
    columns = first.withColumn("region", F.when(F.col("side") == -1, 1).when(F.col("side") == 0, 2).otherwise(3))
    ended = F.min(F.when(F.col("is_boundary") | (F.col("is_start") & F.col("is_likely")), F.struct("page", "y0"))).over(Window.partitionBy("doc_id", "region"))
    columns = columns.withColumn("ended", ended).where("ended is null or struct(page, y0) < ended").withColumn("boundary", F.when(F.col("ended").isNotNull(), "abstract-boundary")).drop("ended")
    regions = body.unionByName(columns)
    regions = write_table(regions.select("doc_id", "region", "page", "k", "x0", "y0", "text", "boundary"), "regions")
    index = align.region_index(regions, keys=["doc_id", "region"])
    index = write_table(index.join(regions.groupBy("doc_id", "region").agg(F.max("boundary").alias("boundary")), ["doc_id", "region"]), "region-index")
    anchored = align.passage_anchors(metadata.where("abstract <> ''"), kind="abstract", id_col="doc_id", text_col="abstract")
    anchored = write_table(anchored.join(metadata.select("doc_id", F.col("abstract").alias("expected")), "doc_id"), "anchored")
    hits = align.locate_in_region(index, anchored, on=["doc_id"], kind="abstract").join(anchored.select("doc_id", "expected"), "doc_id").join(index.select("doc_id", "region", F.transform("places", lambda p: p["k"]).alias("all_ks")), ["doc_id", "region"])
    n = F.char_length("target")
    tail, prefix = F.col("target_end") >= n * 0.82, F.col("target_start") <= n * 0.18
    hits = hits.withColumns({"ks": F.when(tail & (F.col("lines") >= 2), F.col("ks")).otherwise(F.col("all_ks")), "tail": tail, "prefix": prefix, "boundary": F.when(tail, "metadata-tail").otherwise(F.col("boundary"))})
    hits = write_table(hits, "region-hits")
    texts = align.word_coverage(_text_of(lines, hits), expected="expected", actual="region_text")
    state = align.validated_abstract(matched=F.col("matched"), anchor_count=F.col("anchor_count"), has_prefix=F.col("prefix"), has_tail=F.col("tail"), boundary=F.col("boundary"), coverage=F.col("word_coverage"))
    good = texts.withColumn("state", state).where("state is not null").withColumns({"coverage": F.when(F.col("state.completeness") == "verified", F.col("coverage")).otherwise(F.col("word_coverage")), "lines": F.size("ks"), "lines_key": F.array_join("ks", "|")})
    good = write_table(good, "region-targets")
    headed = good.where("region = 0")
    others = align.unambiguous(good.where("region > 0"), keys=["doc_id"], identity="lines_key").join(headed.select("doc_id"), "doc_id", "left_anti")
    located = headed.unionByName(others).select("doc_id", F.col("region_text").alias("text"), "ks", "coverage", "matched", F.col("state.confidence").alias("confidence"), F.col("state.completeness").alias("completeness"), "boundary", F.lit("metadata-segmented").alias("method"))
    # what stands below a heading, up to a boundary, when the passage is close to it or unknown
    spare = body.groupBy("doc_id", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "y0", "x0", "k"))), lambda x: x["k"]).alias("ks"), F.max("boundary").alias("boundary")).where("size(ks) >= 2 and boundary is not null").join(located.select("doc_id"), "doc_id", "left_anti")
    spare = _text_of(lines, spare).join(metadata.select("doc_id", F.col("abstract").alias("expected")), "doc_id", "left").withColumn("expected", F.when(F.coalesce("expected", F.lit("")) == "", F.col("region_text")).otherwise(F.col("expected")))
    spare = align.word_coverage(spare, expected="expected", actual="region_text").where(F.col("word_coverage") >= S.HIGH_COVERAGE)
    spare = spare.select("doc_id", F.col("region_text").alias("text"), "ks", F.col("word_coverage").alias("coverage"), F.lit(0).cast("long").alias("matched"), F.lit("medium").alias("confidence"), F.lit("inferred").alias("completeness"), "boundary", F.lit("layout-fallback").alias("method"))
    return _shaped(located, "abstract").unionByName(_shaped(spare, "abstract"))


def metadata_targets(found: dict[str, DataFrame], metadata: DataFrame) -> DataFrame:
    """M9: title and abstract targets of every document; ``metadata`` has doc_id, title, abstract."""
    return title_targets(found, metadata).unionByName(abstract_targets(found, metadata))
