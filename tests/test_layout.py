from pyspark.sql import functions as F

from pagewright.operators import apportion, front_matter, layout, targets
from pagewright.plans import catalogue

GLYPHS = "doc_id long, page long, offset long, c string, x0 double, y0 double, x1 double, y1 double, font string, break_after boolean, space_after boolean, ignorable boolean, rotation double"


def glyphs(spark, pages):
    rows = []
    for page, lines in enumerate(pages):
        n = 0
        for text, x, top, height, width in lines:
            for i, c in enumerate(text):
                w = 3.0 if c == " " else width
                rows.append((1, page, n, c, x, top, x + w, top + height, "F", i == len(text) - 1, c == " ", False, 0.0))
                x, n = x + w, n + 1
    return spark.createDataFrame(rows, GLYPHS)


FRONT = [
    ("Synthetic Article Title", 165.0, 25.0, 20.0, 7.0), ("Alice Example", 240.0, 55.0, 10.0, 5.0), ("Abstract", 40.0, 85.0, 12.0, 5.0), ("This is a synthetic abstract.", 40.0, 110.0, 10.0, 5.0), ("It has two lines.", 40.0, 128.0, 10.0, 5.0),
    ("Keywords: clay model", 40.0, 155.0, 10.0, 5.0), ("1 Introduction", 40.0, 180.0, 12.0, 5.0), ("The body begins here.", 40.0, 205.0, 10.0, 5.0), ("More body text follows.", 40.0, 223.0, 10.0, 5.0),
]


def test_front_page(spark):
    lines = front_matter.front_lines(glyphs(spark, [FRONT])).cache()
    texts = {r["k"]: r["text"] for r in lines.collect()}
    assert [texts[k] for k in sorted(texts)] == [f[0] for f in FRONT]
    found = front_matter.extract(lines)
    assert texts[found["body_start"].first()["k"]] == "1 Introduction"
    abstract = found["abstract"].collect()
    assert [texts[r["k"]] for r in sorted(abstract, key=lambda r: r["k"])] == ["Abstract", "This is a synthetic abstract.", "It has two lines."]
    assert {r["boundary"] for r in abstract} == {"abstract-boundary"}
    title = found["titles"].where("rank = 1").first()
    assert title["text"] == "Synthetic Article Title" and title["confidence"] == "medium"
    assert found["bands"].count() == 1


def test_known_title_and_abstract_are_located(spark):
    found = front_matter.extract(front_matter.front_lines(glyphs(spark, [FRONT])))
    known = spark.createDataFrame([(1, "Synthetic Article Title", "This is a synthetic abstract. It has two lines.")], "doc_id long, title string, abstract string")
    got = {r["kind"]: r for r in targets.metadata_targets(found, known).collect()}
    assert got["title"]["text"] == "Synthetic Article Title" and got["title"]["ks"] == [0] and got["title"]["confidence"] == "high"
    assert got["abstract"]["text"] == "This is a synthetic abstract. It has two lines." and got["abstract"]["ks"] == [3, 4] and got["abstract"]["completeness"] == "verified"
    unknown = spark.createDataFrame([(1, "", "")], "doc_id long, title string, abstract string")
    spare = {r["kind"]: r for r in targets.metadata_targets(found, unknown).collect()}
    assert spare["title"]["method"] == spare["abstract"]["method"] == "layout-fallback" and spare["abstract"]["ks"] == [3, 4]


def test_empty_documents_have_codes(spark):
    docs = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, pages int")
    got = {r["doc_id"]: r["error_code"] for r in front_matter.errors(docs, glyphs(spark, [FRONT])).collect()}
    assert got == {2: "empty-pdf", 3: "pdf-text-layer-empty"}


def test_rejected_glyphs(spark):
    rows = [(1, 0, 0, "a", 0.0, 0.0, 5.0, 5.0, "F", False, False, True, 0.0), (1, 0, 1, "b", 0.0, 0.0, 0.0, 5.0, "F", False, False, False, 0.0), (1, 0, 2, "c", 0.0, 0.0, 5.0, 5.0, "F", False, False, False, 90.0), (1, 0, 3, " ", 0.0, 0.0, 5.0, 5.0, "F", False, False, False, 0.0), (1, 0, 4, "d", 0.0, 0.0, 5.0, 5.0, "F", False, False, False, 359.0)]
    got = {r["c"]: r["reason"] for r in front_matter.admitted(spark.createDataFrame(rows, GLYPHS)).collect()}
    assert got == {"a": "ignorable-character", "b": "invalid-character-geometry", "c": "rotated-or-vertical-text", "d": None}


def test_row_clustering_against_its_definition(spark):
    items = spark.createDataFrame([(1, 0, i, f"w{i}", 10.0 * i, y, 10.0 * i + 8, y + 10, 10.0, "F", i == 2) for i, y in enumerate([0.0, 3.0, 1.0, 20.0, 2.0])], "doc_id long, page long, i long, text string, x0 double, y0 double, x1 double, y1 double, h double, font string, break_after boolean")
    rows = {r["i"]: r["visual_row"] for r in layout.cluster_rows(items).collect()}
    assert rows == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0}
    front = {r["i"]: r["visual_row"] for r in layout.cluster_rows(items, rule="front").collect()}
    assert front[0] == front[2] and front[3] not in (front[0],) and front[4] != front[2]


def test_captions(spark):
    lines = [(0, "Body text that ends.", 0.0, 10.0), (1, "Figure 1. A short caption", 60.0, 9.0), (2, "small words on", 72.0, 9.0), (3, "Body again that goes on and on here", 130.0, 10.0)]
    df = spark.createDataFrame([(1, 0, k, t, 0.0, y, 5.0 * len(t), y + h, h, "f", 0.0, 600.0, k) for k, t, y, h in lines], "doc_id long, page long, k long, text string, x0 double, y0 double, x1 double, y1 double, h double, flow_key string, flow_left double, flow_right double, order_index long")
    assert {r["k"]: r["reason"] for r in layout.captions_and_labels(df).collect()} == {0: "figure-label", 1: "figure-caption", 2: "figure-caption"}


def test_hyphens(spark):
    rows = [(1, 0, "The exam-", 0.0, 280.0), (1, 1, "ple is well-", 0.0, 280.0), (1, 2, "known here", 0.0, 100.0)]
    df = spark.createDataFrame([(*r, 0.0, 300.0) for r in rows], "d long, k long, text string, x0 double, x1 double, flow_left double, flow_right double")
    out = layout.dehyphenated(df, keys=["d"]).first()
    assert out["text"] == "The example is well- known here" and out["dehyphenated"] == 1


def test_medians(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = df.agg(layout.median_mean(F.col("x")).alias("a"), layout.median_upper(F.col("x")).alias("b")).first()
    assert (r["a"], r["b"]) == (2.5, 3.0)
    e = df.where("false").agg(layout.median_mean(F.col("x")).alias("a"), layout.median_upper(F.col("x")).alias("b")).first()
    assert (e["a"], e["b"]) == (0.0, 0.0)


def test_flow_moves_on_what_does_not_fit():
    box = {"x0": 0.0, "y0": 0.0, "x1": 108.0, "y1": 26.0, "h": 12.0}
    text = "word " * 30
    chunks, layouts = apportion.flow(text, [box, {**box, "x1": 608.0, "y1": 206.0}])
    assert "".join(chunks) == text and all(v["rendered"] for v in layouts)
    assert not apportion.fit_block("x" * 5000, 100, 20, 12)["rendered"]


def test_merged_parts(spark):
    rect = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame([(1, 0, 0, (0.0, 0.0, 5.0, 5.0)), (1, 0, 1, (2.0, 6.0, 9.0, 9.0)), (1, 1, 2, (1.0, 1.0, 2.0, 2.0))], f"r long, page long, part long, rect {rect}")
    assert {(x["page"], tuple(x["rect"])) for x in apportion.merged_parts(df, keys=["r"]).collect()} == {(0, (0, 0, 9, 9)), (1, (1, 1, 2, 2))}
    assert {(x["page"], tuple(x["rect"])) for x in apportion.merged_parts(df, keys=["r"], title=True).collect()} == {(0, (0, 0, 9, 9)), (1, (1, 1, 2, 2))}


def test_captions_take_one_pass_over_the_lines(spark):
    lines = [(1, 0, "l", 0, "tick", 0.0, 20.0), (1, 0, "r", 1, "tick", 320.0, 20.0), (1, 0, "l", 2, "Figure 1. A short caption", 0.0, 60.0), (2, 0, "l", 0, "tick", 0.0, 20.0), (None, 0, "l", 0, "tick", 0.0, 20.0), (None, 0, "l", 1, "Figure 2. Another one", 0.0, 60.0)]
    df = spark.createDataFrame([(d, p, k, t, x, y, x + 5.0 * len(t), y + 9, 9.0, f, 0.0 if f == "l" else 300.0, 300.0 if f == "l" else 600.0, k) for d, p, f, k, t, x, y in lines], "doc_id long, page long, k long, text string, x0 double, y0 double, x1 double, y1 double, h double, flow_key string, flow_left double, flow_right double, order_index long")
    out = layout.captions_and_labels(df)
    plan = str(out._jdf.queryExecution().executedPlan())
    assert "FlatMapGroupsInPandas" not in plan and "Join" not in plan
    assert {tuple(r) for r in out.collect()} == {(1, 0, 0, "figure-label"), (1, 0, 2, "figure-caption"), (None, 0, 1, "figure-caption")}


def test_abstracts_make_no_table_of_each_document(spark):
    lines = [(d, 0, k, t, 40.0, 25.0 + 16 * k, 40.0 + 5 * len(t), 35.0 + 16 * k, 10.0) for d in (1, 2) for k, t in enumerate(["A title of some words", "Abstract" if d == 1 else "Nothing", "We tell what we have done.", "1 Introduction", "The body begins here."])]
    judged = front_matter.judged(front_matter.placed(spark.createDataFrame(lines, "doc_id long, page long, k long, text string, x0 double, y0 double, x1 double, y1 double, h double")))
    out = front_matter.abstract_lines(judged, front_matter.body_start(judged))
    assert "FlatMapGroupsInPandas" not in str(out._jdf.queryExecution().executedPlan())
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, "heading", "body-start"), (1, 2, "body", "body-start")]
    flags = str(judged._jdf.queryExecution().analyzed())
    assert flags.count("regexp_replace") < 40  # the text is normalised once, not once a flag


def test_gutters_read_the_lines_once(spark):
    rows = [(1, 0, k, f"line {k}", 40.0 + 280 * (k % 2), 140.0 + 10 * k, 260.0 + 280 * (k % 2)) for k in range(10)]
    found = layout.front_matter_gutter(spark.createDataFrame([*rows, (None, 0, 1, "of no document", 40.0, 140.0, 260.0)], "doc_id long, page long, k long, text string, x0 double, y0 double, x1 double"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert found.collect() == [(1, 0, 290.0)]


def test_titles_take_texts_and_flags_as_they_were_judged(spark):
    found = front_matter.extract(front_matter.front_lines(glyphs(spark, [FRONT])))
    plan = found["titles"]._jdf.queryExecution().optimizedPlan().toString()
    assert found["titles"].where("rank = 1").first()["text"] == "Synthetic Article Title"
    assert plan.count("nfkc(") == 1 and "judged" not in str(found["titles"].inputFiles())  # only the blocks' texts are made normal


def test_targets_read_written_lines_only(spark, sf_dir):
    read = catalogue.QUERIES["metadata_targets"](spark, sf_dir).inputFiles()
    assert read and not any("documents" in f for f in read)
