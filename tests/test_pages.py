import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import predicates as P
from pagewright.functions import spans as S
from pagewright.operators import apportion, front_matter, layout, pages, targets
from tests.test_layout import FRONT, GLYPHS, glyphs


def words(spark, rows):
    """Glyphs that are words: (page, text, x, top, height, font), a gap of 3 between words."""
    out, n = [], {}
    for page, text, x, top, height, font in rows:
        parts = text.split(" ")
        for i, w in enumerate(parts):
            k = n[page] = n.get(page, -1) + 1
            out.append((1, page, k, w, x, top, x + 5.0 * len(w), top + height, font, i == len(parts) - 1, True, False, 0.0))
            x += 5.0 * len(w) + 3
    return spark.createDataFrame(out, GLYPHS)


PROSE = "some body words that fill a line of the column"


def three_pages():
    rows = []
    for page in range(3):
        rows += [(page, f"Journal of Things {page + 1}", 200.0, 20.0, 8.0, "H"), (page, str(page + 11), 300.0, 780.0, 8.0, "H")]
        for i in range(14):
            rows += [(page, f"{PROSE}", 40.0, 200.0 + 16 * i, 12.0, "B"), (page, f"{PROSE}", 320.0, 200.0 + 16 * i, 12.0, "B")]
    rows += [(0, "Figure 1. What is seen", 40.0, 460.0, 10.0, "B"), (0, "x = y + z", 40.0, 500.0, 12.0, "M")]
    rows += [(1, "* Corresponding author here", 40.0, 700.0, 9.0, "B"), (1, "Published by X, all rights reserved", 40.0, 620.0, 11.0, "B")]
    return rows


def test_whole_pages_from_glyphs(spark):
    out = {(r["page"], r["text"], r["x0"], r["y0"]): r for r in pages.ordered_pages(words(spark, three_pages())).collect()}
    assert len(out) == len(three_pages()) and {r["body_height"] for r in out.values()} == {12.0}
    reason = lambda page, start: {r["reason"] for (p, t, _, _), r in out.items() if p == page and t.startswith(start)}
    for page in range(3):
        assert reason(page, "Journal") == {"repeated-header"} and reason(page, str(page + 11)) == {"page-number"} and reason(page, "some body") == {None}
    assert reason(0, "Figure") == {"figure-caption"} and reason(0, "x = y") == {"display-formula"} and reason(1, "* Corr") == {"footnote"} and reason(1, "Published") == {"publisher-metadata"}
    body = [r for r in out.values() if r["text"] == PROSE]
    assert {r["body_font_fraction"] for r in body} == {1.0} and {r["primary_font"] for r in body} == {"B"}
    left, right = ([r["order_index"] for r in body if r["page"] == 2 and r["x0"] == x] for x in (40.0, 320.0))
    assert max(left) < min(right)
    assert {r["transition"] for r in out.values() if r["page"] > 0 and r["order_index"] == 0} == {"page-break"}


def test_front_matter_with_the_documents_own_body_height(spark):
    found = pages.extract(glyphs(spark, [FRONT]))
    texts = {r["k"]: r["text"] for r in found["lines"].collect()}
    assert texts[found["body_start"].first()["k"]] == "1 Introduction"
    assert {texts[r["k"]] for r in found["abstract"].collect()} == {"Abstract", "This is a synthetic abstract.", "It has two lines."}
    assert found["titles"].where("rank = 1").first()["text"] == "Synthetic Article Title"
    larger = [(t, x, 1.2 * top, 1.2 * h, w) for t, x, top, h, w in FRONT]
    large = pages.extract(glyphs(spark, [larger]))
    assert {r["body_height"] for r in large["lines"].collect()} == {12.0}
    assert large["titles"].where("rank = 1").first()["text"] == "Synthetic Article Title"


def test_a_small_number_and_words_are_no_heading_by_an_unknown_font(spark):
    rows = [("2 Some words about it all here", 40.0, 200.0, 10.0, 10.0), ("This is a line of the body and goes on.", 40.0, 220.0, 10.0, 8.0)]
    lines = front_matter.judged(front_matter.front_lines(glyphs(spark, [rows])).withColumn("flow_right", F.lit(340.0)))
    assert not any(r["is_likely"] for r in lines.collect())
    assert any(r["is_likely"] for r in front_matter.judged(lines.withColumn("body_font_fraction", F.lit(0.0)).withColumn("h", F.lit(10.6))).collect())


def test_publisher_tails_are_cut_off(spark):
    tail = ("It has two lines. © 2020 A Publisher", 40.0, 128.0, 10.0, 5.0)
    front = [tail if f[0] == "It has two lines." else f for f in FRONT]
    found = front_matter.extract(front_matter.front_lines(glyphs(spark, [front])))
    unknown = spark.createDataFrame([(1, "", "")], "doc_id long, title string, abstract string")
    got = {r["kind"]: r["text"] for r in targets.metadata_targets(found, unknown).collect()}
    assert got["abstract"] == "This is a synthetic abstract. It has two lines."
    texts = ["a b © c", "© a", "a Copyright b", "all  rights reserved", "x all rights reserved.", "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(P.before_publisher_tail(F.col("t")).alias("r"))
    assert [r["r"] for r in df.collect()] == ["a b", None, "a", None, "x", None, None]


def line(**more):
    return {"page": 0, "x0": 40.0, "x1": 560.0, "y0": 100.0, "y1": 110.0, "h": 10.0, "gutter": 300.0, "side": -1, "flow_left": 0.0, "flow_right": 600.0} | more


def test_a_tail_goes_on_only_below_two_lines_that_belong_together():
    heading = line(y0=80.0, y1=90.0, x1=100.0, side=0)
    first, tail = line(), line(y0=124.0, y1=134.0, x1=300.0)
    near, far, moved = line(y0=112.0, y1=122.0), line(y0=180.0, y1=190.0), line(y0=112.0, y1=122.0, x0=58.0)
    goes = lambda second, last: front_matter._tail_of_span(last, heading, [first, second], 600.0)
    assert goes(near, tail) and not goes(far, line(y0=192.0, y1=202.0, x1=300.0))
    assert goes(moved, tail) and not goes(line(y0=112.0, y1=122.0, x0=20.0, h=1.0), tail)
    outside = lambda g: front_matter._seed(line(gutter=g), heading, 600.0)
    assert outside(300.0) and not outside(0.0) and not outside(700.0) and not outside(None)


def test_a_part_that_cannot_be_rendered_fails_the_record():
    box = {"x0": 0.0, "y0": 0.0, "x1": 108.0, "y1": 26.0, "h": 12.0}
    chunks, layouts = apportion.flow("word " * 400, [box, box])
    assert chunks == ["", ""] and len(layouts) == 2 and not any(v["rendered"] for v in layouts) and layouts[0]["failure"] == "minimum-font-overflow"


def test_what_moves_on_starts_at_a_good_place_and_keeps_graphemes():
    box = {"x0": 0.0, "y0": 0.0, "x1": 108.0, "y1": 26.0, "h": 12.0}
    text = "One sentence ends. " * 6 + "é" * 40
    chunks, layouts = apportion.flow(text, [box, {**box, "x1": 608.0, "y1": 206.0}])
    assert "".join(chunks) == text and all(v["rendered"] for v in layouts) and set(chunks[0][-1] + chunks[1][0]) & set(" .")
    assert not chunks[1].startswith("́")


def test_cuts_keep_characters_and_limits():
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice("ab c.!;。\n 😀é") for _ in range(rng.randint(0, 50)))
        limit = rng.randint(2, 20)
        parts = S.cut_text(text, limit)
        assert "".join(parts) == text and all(0 < len(p.encode("utf-16-le")) <= 2 * limit for p in parts) or not text


@pytest.mark.parametrize("rule", ["layout", "front"])
def test_rows_of_random_pages_against_their_definition(spark, rule):
    rng = random.Random(9)
    items = [(1, p, i, f"w{i}", rng.uniform(0, 500), y := rng.choice([0.0, 3.0, 5.0, 9.0, 20.0, 23.0, 40.0]) + rng.random(), h := rng.choice([8.0, 10.0, 14.0]), y + h, i % 7 == 6) for p in range(12) for i in range(rng.randint(1, 25))]
    df = spark.createDataFrame([(d, p, i, t, x, y, x + 20, b, h, e) for d, p, i, t, x, y, h, b, e in items], "doc_id long, page long, i long, text string, x0 double, y0 double, x1 double, y1 double, h double, break_after boolean")
    got = {(r["page"], r["i"]): r["visual_row"] for r in layout.cluster_rows(df, rule=rule).collect()}

    def middle(values):
        values = sorted(values)
        return (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2

    least, reach, closes = layout.ROW_RULES[rule]
    for page in range(12):
        rows = []
        for item in sorted((x for x in items if x[1] == page), key=lambda x: (x[5], x[4], x[2])):
            i, top, h, bottom = item[2], item[5], item[6], item[7]
            fits = []
            for row in rows:
                if closes and any(x[8] and x[2] < i for x in row):
                    continue
                low, high = min(x[5] for x in row), max(x[7] for x in row)
                shared = max(0.0, min(high, bottom) - max(low, top)) / max(1.0, min(high - low, bottom - top))
                distance = abs(middle([x[7] for x in row]) - bottom)
                size = h if closes else min(middle([x[6] for x in row]), h)
                if shared >= least or distance <= max(1.2, size * reach):
                    fits.append((distance, rows.index(row)))
            if fits:
                rows[min(fits)[1]].append(item)
            else:
                rows.append([item])
        order = sorted(range(len(rows)), key=lambda r: (min(x[5] for x in rows[r]), r))
        want = {x[2]: order.index(r) for r, row in enumerate(rows) for x in row}
        assert {i: r for (p, i), r in got.items() if p == page} == want
