"""Alignment of known passages with texts and page regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import spans as S
from pagewright.functions import text as T


def passage_anchors(passages: DataFrame, *, kind: str = "abstract", id_col: str = "item_id", text_col: str = "text", compose: bool = True, numeric: bool = True) -> DataFrame:
    """``id_col``, target (normalised text) and anchors of every passage."""
    target = T.strip_abstract_heading(F.col(text_col), compose, numeric)
    return passages.select(id_col, target.alias("target")).withColumn("anchors", S.anchors(F.col("target"), kind))


#: Units of a run by which passages and documents meet.
RUN = 4
#: A unit is a character of a script without spaces, or what stands between spaces and those.
UNIT = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]|[^ \x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]+"


def units(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(UNIT), F.lit(0))


def runs(of: Column, size: Column) -> Column:
    """Hashes of the different runs of ``size`` units; none where there are fewer."""
    starts = F.when(F.size(of) >= size, F.sequence(F.lit(1), F.size(of) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(size, F.array_join(F.slice(of, i, size), " "))))


def candidates(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that have a passage's anchor at the edges of units, and some that have only its rarest run.

    ``texts`` has doc_id and text, ``found`` item_id and anchors. An anchor is looked for by
    one of its runs of RUN units, or all of its units where it has fewer: the run that stands
    in the fewest documents, so a common beginning brings no pairs together. Documents make
    runs of the lengths that anchors have, which a table of one row tells them.
    """
    each = found.select("item_id", F.posexplode("anchors").alias("nth", "a")).select("item_id", "nth", units(F.col("a.text")).alias("u")).where(F.size("u") > 0)
    each = each.withColumn("size", F.least(F.lit(RUN), F.size("u")))
    keys = each.select("item_id", "nth", F.explode(runs(F.col("u"), F.col("size"))).alias("run"))
    sizes = each.agg(F.collect_set("size").alias("sizes"))  # one row, RUN values at most
    made = texts.select("doc_id", units(F.col("text")).alias("u")).join(F.broadcast(sizes)).select("doc_id", F.explode(F.flatten(F.transform("sizes", lambda n: runs(F.col("u"), n)))).alias("run"))
    hits = made.join(keys.select("run").distinct(), "run", "left_semi").repartition("run")
    often = hits.groupBy("run").agg(F.count("*").alias("docs"))
    rarest = keys.join(often, "run", "left").groupBy("item_id", "nth").agg(F.min_by("run", F.struct(F.coalesce("docs", F.lit(0)), "run")).alias("run"))
    return hits.join(rarest, "run").select("doc_id", "item_id").distinct()


def align(docs: DataFrame, passages: DataFrame, *, kind: str = "abstract", compose: bool = True, numeric: bool = True) -> DataFrame:
    """The best passage of every document that holds one: doc_id, item_id, matched, anchor_count, coverage, confidence.

    A pair is looked at when the document has one of the passage's anchors at the edges of
    units (see ``candidates``): equi joins on hashes of runs, never documents times passages.
    Then anchors are searched in order and the coverage decides. Equal ranks go to the smaller
    item_id.
    """
    found = passage_anchors(passages, kind=kind, compose=compose, numeric=numeric).where(F.size("anchors") > 0)
    texts = docs.select("doc_id", T.normalize_front_matter(F.col("text"), compose, numeric).alias("text"))
    looked = candidates(texts, found).join(texts, "doc_id").join(found, "item_id")
    match = S.match_anchors(F.col("text"), F.col("anchors"), F.char_length("target"), kind)
    matched = looked.select("doc_id", "item_id", match.alias("m")).where("m is not null").select("doc_id", "item_id", "m.*")
    best = Window.partitionBy("doc_id").orderBy(F.desc("coverage"), F.desc("matched"), "item_id")
    return matched.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth", "first_start", "last_end", "target_start", "target_end")


def unambiguous(targets: DataFrame, *, keys: list[str], identity: str, margin: float = 0.03) -> DataFrame:
    """T5: the best target of each group by coverage, anchors and lines; none where another one is as good.

    The runner-up is as good when it differs in ``identity``, has as many anchors and less than
    ``margin`` less coverage.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("coverage"), F.desc("matched"), F.desc("lines"), identity)
    ranked = targets.withColumns({"nth": F.row_number().over(w), "next_id": F.lead(identity).over(w), "next_coverage": F.lead("coverage").over(w), "next_matched": F.lead("matched").over(w)})
    rival = F.col("next_id").isNotNull() & (F.col("next_id") != F.col(identity)) & (F.col("coverage") - F.col("next_coverage") < margin) & (F.col("matched") == F.col("next_matched"))
    return ranked.where((F.col("nth") == 1) & ~rival).select(*targets.columns)


def word_coverage(pairs: DataFrame, *, expected: str, actual: str, compose: bool = True, numeric: bool = True) -> DataFrame:
    """F13 on normalised texts: ``pairs`` with word_coverage."""
    return pairs.withColumn("word_coverage", S.ordered_coverage(T.strip_abstract_heading(F.col(expected), compose, numeric), T.normalize_front_matter(F.col(actual), compose, numeric)))


def validated_abstract(*, matched: Column, anchor_count: Column, has_prefix: Column, has_tail: Column, boundary: Column, coverage: Column) -> Column:
    """M8: struct<confidence, completeness>: verified, inferred or null."""
    every = (matched == anchor_count) & has_prefix & has_tail
    inferred = has_prefix & (matched >= 2) & boundary.isin("metadata-tail", "body-start", "abstract-boundary") & (coverage >= S.HIGH_COVERAGE)
    one = lambda a, b: F.struct(F.lit(a).alias("confidence"), F.lit(b).alias("completeness"))
    return F.when(every, one("high", "verified")).when(inferred, one("medium", "inferred"))


def region_index(lines: DataFrame, *, keys: list[str]) -> DataFrame:
    """One searchable text for each region and where each line stands in it.

    Lines in order of page, y0, x0; a hyphen at a line's end goes when the next line begins in
    lower case; white space is single spaces. Returns keys, text, places (array<struct<k, start,
    end>>).
    """
    w = Window.partitionBy(*keys).orderBy("page", "y0", "x0", "k")
    text = T.normalize_front_matter(F.col("text"), compose=False, numeric=False)
    after = F.lead(F.col("text")).over(w)
    part = F.when(text.rlike("-$") & F.coalesce(F.ltrim(after).rlike(r"^\p{Ll}"), F.lit(False)), F.regexp_replace(text, "-$", "")).otherwise(F.concat(text, F.lit(" ")))
    parts = lines.withColumn("part", part).withColumn("start", F.coalesce(F.sum(F.char_length("part")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    places = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.char_length("part")).alias("end"), "k", "part")))
    out = parts.groupBy(*keys).agg(places.alias("p"))
    return out.select(*keys, F.trim(F.array_join(F.transform("p", lambda x: x["part"]), "")).alias("text"), F.transform("p", lambda x: F.struct(x["k"].alias("k"), x["start"].alias("start"), x["end"].alias("end"))).alias("places"))


def locate_in_region(index: DataFrame, anchored: DataFrame, *, on: list[str], kind: str) -> DataFrame:
    """Anchors in a region's text, with the first and last line that they touch."""
    joined = index.join(anchored, on)
    m = S.match_anchors(F.col("text"), F.col("anchors"), F.char_length("target"), kind)
    out = joined.select(*index.columns, "target", m.alias("m")).where("m is not null")
    hit = F.filter("places", lambda p: (p["end"] > F.col("m.first_start")) & (p["start"] < F.col("m.last_end")))
    keys = [c for c in index.columns if c not in ("text", "places")]
    return out.select(*keys, "target", "m.*", F.transform(hit, lambda p: p["k"]).alias("ks")).withColumn("lines", F.size("ks"))


def strategy_cascade(found: list[DataFrame], *, keys: list[str]) -> DataFrame:
    """M9: for each key the row of the first strategy that has one, named in ``strategy``."""
    every = None
    for i, df in enumerate(found):
        one = df.withColumn("strategy", F.lit(i))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("strategy")
    return every.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def search_regions(lines: DataFrame, *, keys: list[str], heading_y: Column, kind: str) -> DataFrame:
    """Lines with the region labels that a search looks through; regions of equal lines are one.

    A title is searched above the heading and on the first two pages, an abstract below it: in
    the whole page, in full-width lines, and in each column of page 0.
    """
    if kind == "title":
        labels = F.filter(F.array(F.when((F.col("page") == 0) & (F.col("y1") <= heading_y), "above"), F.when(F.col("page") <= 1, "wide")), lambda x: x.isNotNull())
    else:
        labels = F.filter(F.array(F.when(F.col("column") == -1, "span"), F.when(F.col("column") == 0, "left"), F.when(F.col("column") == 1, "right"), F.lit("all")), lambda x: x.isNotNull())
        lines = lines.where((F.col("page") == 0) & (F.col("y0") >= heading_y))
    named = lines.withColumn("region", F.explode(labels))
    sets = named.groupBy(*keys, "region").agg(F.xxhash64(F.array_sort(F.collect_list("k"))).alias("lines_key")).groupBy(*keys, "lines_key").agg(F.min("region").alias("region"))
    return named.join(sets.drop("lines_key"), [*keys, "region"], "left_semi")


def segments(targets: DataFrame) -> DataFrame:
    """Targets with text and position as segments, language detected."""
    text = F.trim(F.coalesce("text", F.lit("")))
    return targets.where((text != "") & F.col("position").isNotNull()).select(
        *[c for c in targets.columns if c not in ("text", "confidence")], text.alias("source_text"), T.detect_language(text).alias("source_language"), F.coalesce("confidence", F.lit("low")).alias("confidence"),
    )


def locate_diagnostics(targets: DataFrame, pages: DataFrame, *, keys: list[str]) -> DataFrame:
    """Pages scanned, whether title and abstract were found, whether there is text at all."""
    scanned = pages.groupBy(*keys).agg(F.countDistinct("page").alias("scanned_pages"), F.sum("glyphs").alias("glyphs"))
    found = targets.groupBy(*keys).agg(F.bool_or(F.col("kind") == "title").alias("title"), F.bool_or(F.col("kind") == "abstract").alias("abstract"))
    no = F.lit(False)
    return scanned.join(found, keys, "left").select(*keys, "scanned_pages", F.coalesce("title", no).alias("title_found"), F.coalesce("abstract", no).alias("abstract_found"), (F.coalesce("glyphs", F.lit(0)) > 0).alias("text_layer"))
