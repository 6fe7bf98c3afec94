"""Named queries over the tables: each applies operators of the library to whole tables.

Each function's docstring names the operators that it exercises. ``QUERIES`` maps names to
callables (spark, sf_dir) -> DataFrame. The tables hold no text that compatibility composition
would change, so queries leave it out (``compose=False``) and stay out of Python where the
operator itself does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import hashing as H
from pagewright.functions import predicates as P
from pagewright.functions import spans as S
from pagewright.functions import text as T
from pagewright.operators import align, apportion, enrich, front_matter, layout, selection, store, targets
from pagewright.session import spread, write_table
from pagewright.sources import layouts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.text_lines(table(spark, sf_dir, "documents"))


def flow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the column that they were laid out in as their flow."""
    return lines_of(spark, sf_dir).withColumns({"column": F.col("col"), "flow_key": F.concat_ws(":", "page", "col"), "flow_left": F.when(F.col("col") == 1, 300.0).otherwise(F.lit(0.0)), "flow_right": F.when(F.col("col") == 0, 300.0).otherwise(F.lit(600.0))})


# --- text -------------------------------------------------------------------------------


@query
def align_passages(spark, sf_dir):
    """Benchmark passages located in documents."""
    return align.align(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), compose=False, numeric=False).withColumn("coverage", F.round("coverage", 6))


@query
def lcs_word_coverage(spark, sf_dir):
    """Ordered word coverage of each passage in the document that holds it."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    pairs = align.align(docs, items, compose=False, numeric=False).select("doc_id", "item_id", "matched", "anchor_count", "coverage")
    joined = pairs.join(items.select("item_id", F.col("text").alias("expected")), "item_id").join(docs.select("doc_id", F.col("text").alias("actual")), "doc_id")
    out = align.word_coverage(joined, expected="expected", actual="actual", compose=False, numeric=False)
    state = align.validated_abstract(matched=F.col("matched"), anchor_count=F.col("anchor_count"), has_prefix=F.lit(True), has_tail=F.col("coverage") >= 0.82, boundary=F.lit("metadata-tail"), coverage=F.col("word_coverage"))
    return out.select("doc_id", "item_id", F.round("word_coverage", 6).alias("word_coverage"), state["completeness"].alias("completeness"))


@query
def title_anchors(spark, sf_dir):
    """anchors of passages as titles and as abstracts."""
    items = table(spark, sf_dir, "benchmark")
    one = lambda kind: align.passage_anchors(items, kind=kind, compose=False, numeric=False).select("item_id", F.lit(kind).alias("kind"), F.posexplode("anchors").alias("pos", "a")).select("item_id", "kind", F.col("pos").cast("long").alias("pos"), F.col("a.text").alias("anchor"), F.col("a.start").alias("anchor_start"), F.col("a.end").alias("anchor_end"))
    return one("title").union(one("abstract"))


@query
def detect_language_mix(spark, sf_dir):
    """F8, A4: documents and turns by detected script."""
    texts = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), "text").union(table(spark, sf_dir, "conversations").select(F.lit("conversations"), "text"))
    return texts.groupBy("source", T.detect_language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


@query
def text_stats(spark, sf_dir):
    """A3, F1: character statistics of every document."""
    s = table(spark, sf_dir, "documents").select("doc_id", T.stats(F.col("text"), False).alias("s")).select("doc_id", "s.*")
    return s.select("doc_id", "chars", "letters", "digits", "operators", "words", "numeric_tokens", *[F.round(c, 9).alias(c) for c in ("letter_ratio", "digit_ratio", "operator_ratio")])


@query
def html_to_text(spark, sf_dir):
    """pages with entities decoded and tags removed."""
    pages = table(spark, sf_dir, "pages")
    text = T.normalize_front_matter(F.col("html"), False, False)
    return pages.select("page_id", F.char_length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"), F.md5(T.preview(F.col("html")).cast("binary")).alias("preview_md5"))


@query
def edge_key_repeats(spark, sf_dir):
    """Page edges that several documents share, numbers masked."""
    return layout.repeated_edges(lines_of(spark, sf_dir), keys=[], units="doc_id", least_share=0.0, compose=False)


def heading_variants(spark, sf_dir):
    lines = flow_lines(spark, sf_dir)
    numbered = F.concat((F.col("k") % 120).cast("string"), F.lit(". "), F.col("text"))
    keyword = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Introduction", "References", "Abstract", "METHODS", "1. Background", "A p p e n d i x")]), (F.col("k") % 6 + 1).cast("int")), F.when(F.col("k") % 4 == 0, F.concat(F.lit(" "), F.col("text"))).otherwise(""))
    plain = lines.withColumn("variant", F.lit("plain"))
    return plain.union(lines.withColumns({"text": numbered, "variant": F.lit("numbered")})).union(lines.withColumns({"text": keyword, "variant": F.lit("keyword")}))


@query
def heading_candidates(spark, sf_dir):
    """Lines, numbered lines and section words by kind of heading."""
    v, text = heading_variants(spark, sf_dir), F.col("text")
    likely = P.likely_heading(text, font_height=F.col("h"), body_height=F.lit(10.0), body_font_fraction=F.lit(0.0), width=F.col("x1") - F.col("x0"), flow_width=F.col("flow_right") - F.col("flow_left"), compose=False)
    n = lambda c, name: F.count_if(c).alias(name)
    return v.groupBy("doc_id", "variant").agg(
        F.count("*").alias("lines"), n(P.page_number(text, False), "page_numbers"), n(P.terminal_heading(text, False), "terminal"), n(P.start_heading(text, False), "starting"), n(P.abstract_heading(text, False), "abstracts"),
        n(P.numbered_heading(text, False).isNotNull(), "numbered"), n(likely, "likely"), n(P.ends_terminal(text), "ended"),
    )


@query
def caption_leads(spark, sf_dir):
    """Captions by kind, separator and whether they go on as prose."""
    k = F.col("k")
    lead = F.when(k % 4 == 0, "Figure ").when(k % 4 == 1, "Table ").when(k % 4 == 2, "fig. ").otherwise("Chart A")
    after = F.when(k % 5 == 0, ": ").when(k % 5 == 1, " shows ").when(k % 5 == 2, " - ").when(k % 5 == 3, ". This ").otherwise(" ")
    c = lines_of(spark, sf_dir).select("doc_id", P.caption_lead(F.concat(lead, (k % 30).cast("string"), after, F.col("text")), False).alias("c")).where("c is not null").select("doc_id", "c.*")
    return c.groupBy("kind", "prose", "strong_separator").agg(F.count("*").alias("n"), F.sum(F.char_length("remainder")).alias("chars"))


@query
def author_noise_lines(spark, sf_dir):
    """Noise, authors, artifacts, boundaries, publisher lines and footnotes of every document."""
    lines, text = lines_of(spark, sf_dir), F.col("text")
    n = lambda c, name: F.count_if(c).alias(name)
    h, body = F.col("h"), F.lit(10.0)
    return lines.groupBy("doc_id").agg(
        n(P.front_matter_noise(text, False), "noise"), n(P.author_like(text, False), "author_like"), n(P.author_name_like(text, False), "author_names"), n(P.abstract_boundary(text, False), "boundaries"),
        n(P.artifact_line(text, width=F.col("x1") - F.col("x0"), font_height=h, body_height=body, left_ratio=F.col("x0") / 600, right_ratio=F.col("x1") / 600, compose=False), "artifacts"),
        n(P.publisher_metadata(text, font_height=h, body_height=body, top_ratio=F.col("y0") / 800, bottom_ratio=F.col("y1") / 800, compose=False), "publisher"),
        n(P.footnote(text, font_height=h, body_height=body, bottom_ratio=F.col("y1") / 800, width_ratio=(F.col("x1") - F.col("x0")) / 600, compose=False), "footnotes"),
    )


@query
def prose_signals(spark, sf_dir):
    """Mathematical signs, prose and continuations among the lines of every document."""
    text = F.col("text")
    n = lambda c, name: F.count_if(c).alias(name)
    return lines_of(spark, sf_dir).groupBy("doc_id").agg(F.sum(P.math_signals(text, False)["total"]).cast("long").alias("math"), n(P.natural_prose(text, False), "natural"), n(P.body_prose(text, False), "body"), n(P.continuation_start(text, False), "continuations"))


def _chunked(spark, sf_dir, limit: int) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", "text", S.chunks(F.col("text"), limit).alias("parts"))
    lengths = F.transform("parts", lambda p: F.char_length(p))
    merged = S.sent_and_merged(F.col("parts"))
    return parts.select("doc_id", F.size("parts").cast("long").alias("n"), F.array_max(lengths).cast("long").alias("longest"), (F.array_join("parts", "") == F.col("text")).alias("lossless"), F.char_length(merged).cast("long").alias("merged_chars"), F.md5(F.array_join(F.transform(lengths, lambda x: x.cast("string")), ",").cast("binary")).alias("lengths_md5"))


@query
def chunk_text_2000(spark, sf_dir):
    """documents cut at sentence ends into parts of at most 2000."""
    return _chunked(spark, sf_dir, 2000)


@query
def chunk_text_800(spark, sf_dir):
    """the same with 800."""
    return _chunked(spark, sf_dir, 800)


@query
def stable_hash(spark, sf_dir):
    """two-lane and one-lane hashes of whole documents, addresses and passages."""
    one = lambda name, kind, key, text: table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(text).alias("text"))
    texts = one("documents", "document", "doc_id", "text").union(one("pages", "url", "page_id", "url")).union(one("benchmark", "passage", "item_id", "text"))
    return texts.select("kind", "id", H.stable_hash(F.col("text")).alias("hash"), H.fingerprint(F.col("text")).alias("lane"))


@query
def key_identities(spark, sf_dir):
    """identities and encodings of every label's segment."""
    labels = table(spark, sf_dir, "labels")
    kind = F.when(F.col("toxic") == 1, "custom").otherwise("title")
    rid = H.record_id(F.col("quality").cast("long"), attachmentKey=F.col("doc_id").cast("string"), segmentKind=kind)
    return labels.select("doc_id", rid.alias("record_id"), T.prompt_version(kind, "s1", "f1").alias("prompt"), T.positive_id(F.col("doc_id")).cast("long").alias("item"), T.query_string(q=F.concat(F.lit("a b&"), F.col("doc_id").cast("string"))).alias("pairs"), T.masked_key(F.concat(F.lit("key-"), F.col("doc_id").cast("string"), F.lit("-zz"))).alias("masked"))


# --- geometry and layout ----------------------------------------------------------------


@query
def project_rects(spark, sf_dir):
    """Line rectangles through four page rotations, with failures."""
    k = F.col("k")
    shift = F.when(k % 17 == 0, -700.0).otherwise(F.lit(0.0))
    lines = lines_of(spark, sf_dir).withColumn("pdf", G.rect(F.col("x0") + shift, 800.0 - F.col("y1"), F.when(k % 23 == 0, F.col("x0") + shift).otherwise(F.col("x1") + shift), 800.0 - F.col("y0")))
    scale = F.when(k % 2 == 0, 1.5).otherwise(F.lit(1.0))
    rotation = (k % 4) * 90
    turned = F.pmod(rotation, F.lit(180)) == 90
    viewport = F.when(k % 19 != 0, F.struct(G.rotation_matrix(rotation, F.lit(600.0), F.lit(800.0), scale).alias("matrix"), scale.alias("scale"), (F.when(turned, 800.0).otherwise(F.lit(600.0)) * scale).alias("width"), (F.when(turned, 600.0).otherwise(F.lit(800.0)) * scale).alias("height")))
    lines = lines.withColumn("viewport", viewport).withColumn("p", G.project(F.col("page"), F.lit(1000), F.lit(True), F.col("pdf"), F.col("viewport")))
    at = lambda s: F.round(F.col(f"p.pixel.{s}"), 6).alias(s)
    return lines.select("doc_id", "k", F.col("p.failure_reason").alias("reason"), F.col("p.pending").alias("pending"), at("x0"), at("y0"), at("x1"), at("y1"), F.round(G.padded_area(F.col("p.unit")), 6).alias("area"))


@query
def glyph_lines(spark, sf_dir):
    """Word items grouped into lines."""
    return layout.item_lines(layouts.line_items(lines_of(spark, sf_dir)))


@query
def split_row_gaps(spark, sf_dir):
    """Segments of rows at wide gaps, by page."""
    items = layout.split_rows(layouts.line_items(lines_of(spark, sf_dir)), row=["doc_id", "page", "k"])
    return items.groupBy("doc_id", "page").agg(F.count_if((F.col("segment") > 0) & (F.col("i") >= 0)).alias("later_items"), F.countDistinct("k", "segment").alias("segments"))


@query
def line_texts(spark, sf_dir):
    """Line texts put together from items, with large gaps."""
    return layout.line_texts(layouts.line_items(lines_of(spark, sf_dir)), line=["doc_id", "k"])


@query
def body_height_mode(spark, sf_dir):
    """The body height of every document."""
    ranked = layout.body_heights(lines_of(spark, sf_dir), keys=["doc_id"])
    return ranked.where("rank = 1").select("doc_id", "height", F.round("score", 4).alias("score"), "pages")


@query
def body_font_set(spark, sf_dir):
    """Fonts that cover the body of every document."""
    return layout.body_fonts(layouts.line_items(lines_of(spark, sf_dir)), keys=["doc_id"]).withColumn("weight", F.col("weight").cast("long"))


@query
def font_shares(spark, sf_dir):
    """Primary font and share of body fonts of every line."""
    items = layouts.line_items(lines_of(spark, sf_dir))
    fonts = layout.body_fonts(items, keys=["doc_id"])
    return layout.font_shares(items, fonts, keys=["doc_id"], line=["doc_id", "k"]).withColumn("body_font_fraction", F.round("body_font_fraction", 9))


@query
def medians_avg_vs_upper(spark, sf_dir):
    """A1, A2: both medians of the quantities of every order."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(layout.median_mean(F.col("l_quantity")).alias("median_mean"), layout.median_upper(F.col("l_quantity")).alias("median_upper"))


@query
def page_bands(spark, sf_dir):
    """Vertical bands of every page."""
    return layout.page_bands(lines_of(spark, sf_dir)).select("doc_id", "page", F.size("cuts").cast("long").alias("n"), F.coalesce(F.try_element_at("cuts", F.lit(1)), F.lit(-1.0)).alias("first_cut"))


@query
def gutter_scan(spark, sf_dir):
    """Column gutters of every page."""
    return layout.gutters(lines_of(spark, sf_dir))


@query
def front_matter_gutter(spark, sf_dir):
    """Gutters between lines side by side."""
    return layout.front_matter_gutter(lines_of(spark, sf_dir))


@query
def reading_order(spark, sf_dir):
    """Reading order of all lines."""
    lines = lines_of(spark, sf_dir)
    out = layout.reading_order(lines, layout.gutters(lines), layout.page_bands(lines))
    return out.select("doc_id", "k", "column", "flow_key", "order_index", "transition")


@query
def table_runs(spark, sf_dir):
    """Runs of aligned rows of cells."""
    items = layouts.line_items(lines_of(spark, sf_dir))
    return layout.table_runs(items.withColumn("row", F.col("k")), flow=["doc_id", "page"], compose=False)


def formula_lines(spark, sf_dir):
    k = F.col("k")
    text = F.when(k % 9 == 0, F.concat(F.lit("x = "), k.cast("string"), F.lit(" + y"))).when(k % 9 == 1, F.concat(F.lit("("), (k % 50).cast("string"), F.lit(")"))).when(k % 9 == 2, "ab").otherwise(F.col("text"))
    return flow_lines(spark, sf_dir).withColumns({"text": text, "multi_baseline": F.lit(False), "x1": F.when(k % 9 < 3, F.col("x0") + 60).otherwise(F.col("x1"))})


@query
def formula_regions(spark, sf_dir):
    """Lines of display formulas."""
    return layout.formula_regions(formula_lines(spark, sf_dir), flow=["doc_id", "page", "col"], compose=False)


@query
def captions_and_labels(spark, sf_dir):
    """Captions, what follows them, and labels above figures."""
    k = F.col("k")
    text = F.when(k % 13 == 7, F.concat(F.when(k % 2 == 0, "Figure ").otherwise("Table "), (k % 30).cast("string"), F.lit(". "), F.col("text"))).otherwise(F.col("text"))
    return layout.captions_and_labels(flow_lines(spark, sf_dir).withColumns({"text": text, "order_index": k}))


@query
def row_clustering(spark, sf_dir):
    """Visual rows of items by nearest baseline."""
    items = layouts.line_items(lines_of(spark, sf_dir)).withColumn("i", F.col("k") * 64 + F.col("i"))
    return layout.cluster_rows(items).groupBy("doc_id", "page").agg(F.countDistinct("visual_row").alias("rows"), F.sum("visual_row").alias("row_sum"))


@query
def row_clustering_frontmatter(spark, sf_dir):
    """The same with rows that line ends close."""
    items = layouts.line_items(lines_of(spark, sf_dir)).withColumn("i", F.col("k") * 64 + F.col("i"))
    return layout.cluster_rows(items, rule="front").groupBy("doc_id", "page").agg(F.countDistinct("visual_row").alias("rows"), F.sum("visual_row").alias("row_sum"))


@query
def block_building(spark, sf_dir):
    """Blocks of lines."""
    out = layout.blocks(flow_lines(spark, sf_dir), keys=["doc_id"], compose=False)
    return out.select("doc_id", "block", "page", "lines", "x0", "y0", "x1", "y1", "h", "centered", F.md5(F.array_join("ks", ",").cast("binary")).alias("ks_md5"))


def article_texts(spark, sf_dir) -> DataFrame:
    """Lines of documents with the words of an article's sections put in."""
    k, text = F.col("k"), F.col("text")
    made = F.when(k == 2, "Abstract").when(k == 6, F.concat(F.lit("Keywords: "), text)).when(k == 8, "1 Introduction").otherwise(text)
    return lines_of(spark, sf_dir).withColumn("text", made).drop("col", "row")


def article_lines(spark, sf_dir) -> DataFrame:
    """The same, placed on their pages."""
    return front_matter.placed(article_texts(spark, sf_dir))


@query
def abstract_region(spark, sf_dir):
    """Abstract lines of articles and where they end."""
    found = front_matter.extract(article_lines(spark, sf_dir), titles=False)
    return found["abstract"].groupBy("doc_id", "boundary").agg(F.count_if(F.col("role") == "body").alias("lines"), F.min("k").alias("heading_k"), F.max("k").alias("last_k"))


@query
def title_candidates(spark, sf_dir):
    """Best title candidate of every article."""
    found = front_matter.extract(article_lines(spark, sf_dir))
    return found["titles"].where("rank = 1").select("doc_id", "page", "score", "confidence", F.char_length("text").alias("n_chars"))


@query
def metadata_targets(spark, sf_dir):
    """Each article's known title and abstract found on its lines."""
    text = lambda low, high: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k").between(low, high), F.struct("k", "text")))), lambda x: x["text"]), " ")
    known = write_table(article_texts(spark, sf_dir).groupBy("doc_id").agg(text(0, 0).alias("title"), text(3, 5).alias("abstract")), "known")
    out = targets.metadata_targets(front_matter.extract(article_lines(spark, sf_dir)), known)
    return out.select("doc_id", "kind", F.array_join("ks", ",").alias("ks"), F.round("coverage", 6).alias("coverage"), "confidence", "completeness", "boundary", "method")


@query
def dehyphenate_join(spark, sf_dir):
    """Lines of every page and column joined, broken words mended."""
    k = F.col("k")
    lines = flow_lines(spark, sf_dir).withColumns({"text": F.when(k % 3 == 0, F.concat("text", F.lit("-"))).otherwise(F.col("text")), "x1": F.when(k % 6 == 0, F.col("flow_left") + 250).otherwise(F.col("x1"))})
    return layout.dehyphenated(lines, keys=["doc_id", "page", "col"]).select("doc_id", "page", "col", F.char_length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "dehyphenated")


# --- selections -------------------------------------------------------------------------


def line_rects(spark, sf_dir):
    lines = lines_of(spark, sf_dir)
    rects = lines.select("doc_id", "page", F.col("k").alias("rect_no"), G.rect(F.col("x0") + 5, F.col("y0") + F.when(F.col("k") % 5 == 0, 8.0).otherwise(F.lit(3.0)), F.col("x1") + 5, F.col("y1") + F.when(F.col("k") % 5 == 0, 8.0).otherwise(F.lit(3.0))).alias("rect"))
    return rects, lines.select("doc_id", "page", F.col("k").alias("order"), G.rect("x0", "y0", "x1", "y1").alias("rect"))


@query
def rect_line_match(spark, sf_dir):
    """The best line under each selected rectangle, if it is clear."""
    found = selection.best_lines(selection.rect_candidates(*line_rects(spark, sf_dir), page=["doc_id", "page"]), page=["doc_id", "page"])
    return found.withColumn("score", F.round("score", 6))


@query
def rect_line_match_greedy(spark, sf_dir):
    """One line for each rectangle, taken lines left out."""
    return selection.match_lines(selection.rect_candidates(*line_rects(spark, sf_dir), page=["doc_id", "page"]), page=["doc_id", "page"])


@query
def selection_classify(spark, sf_dir):
    """Layout class of selections of five lines."""
    lines = lines_of(spark, sf_dir)
    known = lines.select("doc_id", "page", F.concat_ws(":", "page", "k").alias("line_id"), F.col("k").alias("order"), F.col("col").cast("string").alias("flow_id"), (F.col("k") % 97 == 0).alias("flow_conflict"))
    sel = F.floor(F.col("k") / 5).cast("long")
    picked = lines.withColumn("sel", sel).where(~((F.col("k") % 5 == 2) & (F.col("sel") % 3 == 1)))
    picked = picked.select("doc_id", "sel", F.col("k").alias("rect_no"), "page", F.when(F.col("k") % 31 == 0, "none").otherwise(F.concat_ws(":", "page", "k")).alias("line_id"), F.when(F.col("sel") % 11 == 0, (F.col("k") % 2).cast("string")).alias("flow_id"))
    return selection.classify(picked, known, selection=["doc_id", "sel"])


@query
def paragraph_units(spark, sf_dir):
    """Units between blank lines."""
    text = F.replace(F.col("text"), F.lit(".\n"), F.lit(".\r\n \n"))
    units = selection.explicit_units(text)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(units).cast("long").alias("n"), F.md5(F.array_join(units, "|").cast("binary")).alias("units_md5"))


def column_rows(spark, sf_dir) -> DataFrame:
    """Lines numbered in their columns; every seventh is indented, every ninth centred and narrow with room around it."""
    k = F.col("k")
    narrow = k % 9 == 4
    lines = lines_of(spark, sf_dir).withColumns({"y1": F.col("y0") + F.when(narrow, 4.0).otherwise(F.lit(10.0)), "row_index": F.row_number().over(Window.partitionBy("doc_id", "page", "col").orderBy("k")) - 1})
    return lines.withColumns({"x0": F.when(narrow, F.col("x0") + 80).when(k % 7 == 0, F.col("x0") + 15).otherwise(F.col("x0")), "x1": F.when(narrow, F.col("x0") + 140).otherwise(F.col("x1"))})


@query
def geometric_breaks(spark, sf_dir):
    """Where the spacing of each column's lines ends paragraphs, and why."""
    out = selection.geometric_breaks(column_rows(spark, sf_dir), block=["doc_id", "page", "col"])
    return out.select("doc_id", "page", "col", F.col("row_index").cast("long").alias("row_index"), F.round("share", 9).alias("share"), F.array_join("reasons", ",").alias("reasons"))


@query
def geometric_units(spark, sf_dir):
    """The same breaks put into each column's text, as units."""
    lines = column_rows(spark, sf_dir)
    block = ["doc_id", "page", "col"]
    breaks = selection.geometric_breaks(lines, block=block).groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("row_index", "share"))).alias("b"))
    texts = lines.groupBy(*block).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("row_count"))
    ready = texts.join(breaks, block, "left").withColumns({"shares": F.coalesce(F.transform("b", lambda x: x["share"]), F.array().cast("array<double>")), "row_indexes": F.coalesce(F.transform("b", lambda x: x["row_index"]), F.array().cast("array<int>"))})
    return selection.with_units(ready).select(*block, F.size("units").alias("n"), F.aggregate("units", F.lit(0), lambda a, u: a + F.char_length(u["source_text"])).alias("n_chars"))


@query
def projection_status(spark, sf_dir):
    """Whether all rectangles of a page can be shown."""
    r = project_rects(spark, sf_dir)
    return selection.projection_status(r.select("doc_id", F.floor(F.col("k") / 10).cast("long").alias("sel"), F.struct((F.col("reason") == "").alias("valid"), "pending").alias("projection")), selection=["doc_id", "sel"])


@query
def page_weights(spark, sf_dir):
    """Bounding boxes and weights of pages."""
    lines = lines_of(spark, sf_dir).select("doc_id", "page", G.rect("x0", "y0", "x1", "y1").alias("rect"))
    out = selection.page_weights(lines, selection=["doc_id"])
    return out.select("doc_id", "page", F.col("rect.x0").alias("x0"), F.col("rect.y0").alias("y0"), F.col("rect.x1").alias("x1"), F.col("rect.y1").alias("y1"), "weight")


@query
def split_replacement(spark, sf_dir):
    """Documents dealt to three parts by weight."""
    weights = F.array(F.lit(3.0), (F.col("doc_id") % 5).cast("double"), F.lit(2.5))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.split_by_weight(F.col("text"), weights)).alias("part", "chunk")).select("doc_id", F.col("part").cast("long").alias("part"), F.char_length("chunk").cast("long").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query
def allocate_chunks(spark, sf_dir):
    """Documents dealt to four parts, cut at good places."""
    docs = table(spark, sf_dir, "documents")
    weights = F.array(F.lit(4.0), F.lit(1.0), (F.col("doc_id") % 7 + 1).cast("double"), F.lit(2.0))
    out = docs.select("doc_id", "text", S.allocated(S.graphemes(F.col("text")), weights).alias("parts"))
    return out.select("doc_id", F.transform("parts", lambda p: F.char_length(p)).alias("lengths"), (F.array_join("parts", "") == F.col("text")).alias("lossless"))


@query
def flow_parts(spark, sf_dir):
    """Passages flowed over two boxes (approximate widths)."""
    box = lambda x, w: F.struct(F.lit(float(x)).alias("x0"), F.lit(0.0).alias("y0"), F.lit(float(x + w)).alias("x1"), F.lit(120.0).alias("y1"), F.lit(10.0).alias("h"))
    records = table(spark, sf_dir, "benchmark").select("item_id", "text", F.array(box(0, 200), box(300, 260)).alias("parts"))
    return apportion.flowed(records, key="item_id").drop("chunk")


# --- store ------------------------------------------------------------------------------


def change_log(spark, sf_dir) -> DataFrame:
    """Events as a change log: user, seq, change, fingerprint, record."""
    e = table(spark, sf_dir, "events")
    change = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "purchase", "put").when(F.col("event_type") == "view", "trash").when(F.col("event_type") == "click", "untrash").when(F.col("event_type") == "error", "delete")
    small = F.floor(F.col("value") / 40).cast("long")
    fp = store.file_fingerprint(F.when((change == "open") & (F.col("event_id") % 10 < 7), small.cast("string")), F.when((change == "open") & (F.col("event_id") % 10 < 9), small), F.lit(5).cast("long"))
    return e.select("user_id", F.col("event_id").alias("seq"), change.alias("change"), fp.alias("fingerprint"), F.concat(F.lit("seg-"), (F.col("event_id") % 5).cast("string")).alias("record"))


@query
def store_upsert(spark, sf_dir):
    """Records that the change log leaves."""
    return store.fold_records(change_log(spark, sf_dir), key=["user_id"], record="record")


@query
def store_trash_purge(spark, sf_dir):
    """Attachment states that the change log leaves."""
    return store.fold_log(change_log(spark, sf_dir), key=["user_id"])


@query
def store_invalidate(spark, sf_dir):
    """Openings under another fingerprint than before, by attachment."""
    opens = change_log(spark, sf_dir).where("change = 'open' and fingerprint is not null")
    before = F.lag("fingerprint").over(Window.partitionBy("user_id").orderBy("seq"))
    return opens.withColumn("before", before).groupBy("user_id").agg(F.count_if(F.col("before") != F.col("fingerprint")).alias("changes"), F.count("*").alias("opens"))


@query
def store_gc_orphans(spark, sf_dir):
    """Records after states of missing items are swept."""
    log = change_log(spark, sf_dir)
    states = store.fold_log(log, key=["user_id"]).select(F.lit(1).cast("long").alias("library_id"), F.col("user_id").cast("string").alias("attachment_key"), F.col("user_id").alias("attachment_item_id"))
    records = store.fold_records(log, key=["user_id"], record="record").select(F.lit(1).cast("long").alias("library_id"), F.col("user_id").cast("string").alias("attachment_key"), "record")
    items = log.select(F.col("user_id").alias("item_id")).distinct().withColumn("found", F.when(F.col("item_id") % 10 == 0, False).when(F.col("item_id") % 10 == 1, F.lit(None).cast("boolean")).otherwise(True))
    return store.collect_garbage(records, states, items)[0].select("attachment_key", "record")


@query
def store_list(spark, sf_dir):
    """Selection records of opened attachments with readable positions, in order of creation."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("custom", "title", "unclassified", "abstract")]), (F.col("event_id") % 4 + 1).cast("int"))
    records = e.select(F.col("event_id").cast("string").alias("record_id"), F.lit(1).cast("long").alias("library_id"), F.col("user_id").cast("string").alias("attachment_key"), F.lit("f").alias("file_fingerprint"), kind.alias("segment_kind"), F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.col("props")).alias("position_json"), F.when(F.col("event_id") % 3 == 0, "de").otherwise("zh-CN").alias("target_language"), F.lit("p").alias("prompt_version"), F.col("event_id").alias("created_at"))
    opened = table(spark, sf_dir, "events").where("event_type = 'signup'")
    attachments = opened.select(F.lit(1).cast("long").alias("library_id"), F.col("user_id").cast("string").alias("attachment_key"), F.lit("f").alias("file_fingerprint")).distinct()
    return store.list_for_attachment(records, attachments, target_language="zh-CN").select("record_id", "attachment_key", "segment_kind", "created_at")


def _status(c: Column) -> Column:
    return F.when(c == "purchase", "translated").when(c == "view", "cached").when(c == "error", "failed").otherwise("skipped")


def _last_results(spark, sf_dir, older: bool) -> DataFrame:
    """Each user's last result among the older or the newer half of all events (by number)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", _status(F.col("event_type")).alias("status"))
    half = e.agg(F.floor((F.min("event_id") + F.max("event_id")) / 2).alias("half"))  # one row
    mine = e.join(F.broadcast(half)).where((F.col("event_id") <= F.col("half")) == F.lit(older))
    return mine.groupBy("user_id").agg(F.max_by("status", "event_id").alias("status"), F.max("event_id").alias("event_id"))


@query
def result_merge_last_good(spark, sf_dir):
    """Each user's last result of the newer half of the events over that of the older half, good ones kept."""
    return store.merge_last_good(_last_results(spark, sf_dir, True), _last_results(spark, sf_dir, False), keys=["user_id"])


@query
def target_merge(spark, sf_dir):
    """Each user's target of the newer half of the events over that of the older half."""
    one = lambda older: _last_results(spark, sf_dir, older).select("user_id", "event_id")
    return store.merge_targets(one(True), one(False), keys=["user_id"])


@query
def notifier_changes(spark, sf_dir):
    """What change events ask for."""
    e = table(spark, sf_dir, "events")
    event = F.element_at(F.array(*[F.lit(x) for x in ("DELETE", "trash", "untrash", "modify", "add", "remove")]), (F.col("event_id") % 6 + 1).cast("int"))
    kind = F.when(F.col("user_id") % 2 == 0, "trash").otherwise("item")
    deleted = F.when(F.col("user_id") % 3 == 0, True).when(F.col("user_id") % 3 == 1, False)
    return e.groupBy(F.coalesce(store.change_kind(event, kind, deleted), F.lit("none")).alias("change")).agg(F.count("*").alias("n"))


@query
def preview_concat(spark, sf_dir):
    """Successful turns of each conversation joined."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("segment_id"), "role", "text")
    results = c.select("segment_id", F.when(F.col("role") == "assistant", "translated").when(F.col("role") == "user", "cached").otherwise("failed").alias("status"), F.concat(F.col("text"), F.lit("<br>x")).alias("translated_text"))
    out = store.preview(c.select("conv_id", "turn", "segment_id"), results, keys=["conv_id"], order="turn")
    return out.select("conv_id", F.md5(F.col("preview").cast("binary")).alias("preview_md5"), "parts")


# --- enrichment -------------------------------------------------------------------------


def segments_of(spark, sf_dir) -> DataFrame:
    """Documents as segments; confidence from the quality label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("title", "abstract", "custom", "figure")]), (F.col("doc_id") % 4 + 1).cast("int"))
    confidence = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("segment_id"), kind.alias("kind"), T.detect_language(F.col("text")).alias("source_language"), confidence.alias("confidence"), F.col("text").alias("source_text"), F.lit(None).cast("array<struct<id:string,source_text:string,break_after:string>>").alias("units"))


@query
def eligibility_status(spark, sf_dir):
    """Which segments may be sent, by kind and confidence."""
    s = segments_of(spark, sf_dir)
    ok = P.eligible(F.col("kind"), F.col("source_language"), F.lit("en"), F.col("confidence"))
    return s.groupBy("kind", "confidence").agg(F.count("*").alias("total"), F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("skipped"))


@query
def enrich_offline(spark, sf_dir):
    """Documents through the store and the offline translator."""
    s = segments_of(spark, sf_dir)
    cached = s.where("segment_id % 5 = 0").select("segment_id", F.concat(F.lit("stored "), F.col("segment_id").cast("string")).alias("translated_text"))
    r = enrich.enrich(s, cached, enrich.Offline())
    return r.select("segment_id", "status", F.char_length("translated_text").cast("long").alias("n_chars"), F.md5(F.col("translated_text").cast("binary")).alias("text_md5"), "error_code")


@query
def auth_circuit_breaker(spark, sf_dir):
    """Calls of each user; after a refused key the rest is failed."""
    e = table(spark, sf_dir, "events").withColumn("http_status", F.element_at(F.array(*[F.lit(x) for x in (200, 200, 429, 200, 500, 200, 200, 404, 200, 200)]), (F.col("event_id") % 10 + 1).cast("int")))
    e = e.withColumn("http_status", F.when(F.col("event_id") % 401 == 400, 401).otherwise(F.col("http_status")))
    r = e.select("user_id", "event_id", "http_status", F.when(F.col("http_status") == 200, "translated").otherwise("failed").alias("status"), F.coalesce(P.error_code(F.col("http_status")), F.lit("")).alias("error_code"))
    return enrich.stopped_queue(r, keys=["user_id"], order="event_id").groupBy("user_id", "status", "error_code").agg(F.count("*").alias("n"))


@query
def retry_classify(spark, sf_dir):
    """Answers that may be tried again."""
    status = F.floor(F.col("value") * 4).cast("int")
    return table(spark, sf_dir, "events").groupBy(P.retryable(status).alias("retryable"), F.coalesce(P.error_code(status), F.lit("")).alias("error_code")).agg(F.count("*").alias("n"))


def responses(spark, sf_dir) -> DataFrame:
    """Turns as answers of a service, some of them wrong."""
    c = table(spark, sf_dir, "conversations")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("title", "abstract", "custom")]), (F.col("conv_id") % 3 + 1).cast("int"))
    made = F.element_at(F.array(*[F.lit(x) for x in ("译文", "译<br>文", "译<b>文</b>", "译a<br />b文", "plain", "一<BR>二<br>三", "译\n\n文", "<br>译", "")]), (F.pmod(F.col("turn") + F.col("conv_id"), F.lit(9)) + 1).cast("int"))
    return c.select("conv_id", "turn", kind.alias("kind"), made.alias("zh"))


@query
def response_validate(spark, sf_dir):
    """Error codes of answers."""
    r = responses(spark, sf_dir)
    return r.groupBy("kind", F.coalesce(enrich.text_error(F.col("kind"), F.col("zh")), F.lit("")).alias("error_code")).agg(F.count("*").alias("n"))


@query
def response_rows(spark, sf_dir):
    """Answers whose rows are not the expected ones."""
    c = table(spark, sf_dir, "conversations")
    expected = c.select("conv_id", F.col("turn").alias("id"))
    rows = c.where(~((F.col("conv_id") % 4 == 1) & (F.col("turn") == 1))).select("conv_id", F.when((F.col("conv_id") % 4 == 2) & (F.col("turn") == 1), 99).otherwise(F.col("turn")).alias("id"))
    rows = rows.withColumn("id", F.when((F.col("conv_id") % 4 == 3) & (F.col("id") == 1), 0).otherwise(F.col("id")))
    return enrich.response_errors(expected, rows, keys=["conv_id"]).select("conv_id", F.coalesce("error_code", F.lit("")).alias("error_code"))
