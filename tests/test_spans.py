import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import spans as S
from pagewright.functions import text as T
from pagewright.operators import align


@given(st.text(alphabet="ab. !?\n;。😀 ", max_size=200), st.integers(1, 40))
@settings(max_examples=300)
def test_cuts_lose_nothing(text, limit):
    parts = S.cut_text(text, limit)
    joined = b"".join(p.encode("utf-16-le", "surrogatepass") for p in parts)
    assert joined == text.encode("utf-16-le")
    assert all(len(p.encode("utf-16-le", "surrogatepass")) // 2 <= limit for p in parts) or len(parts) == 1


def test_cut_at_sentence_ends():
    text = "One here. Two there! Three now? Four at the very end of it."
    parts = S.cut_text(text, 12)
    assert "".join(parts) == text and max(map(len, parts)) <= 12 and parts[0] == "One here. "


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_words(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert S.common_words(a, b) == table[-1][-1]


@given(st.text(alphabet="ab. ,\n", max_size=120), st.lists(st.floats(0.5, 9), min_size=1, max_size=6))
@settings(max_examples=300)
def test_allocation_keeps_all(text, weights):
    parts = S.allocate(list(text), weights)
    assert len(parts) == len(weights) and "".join(parts) == text
    assert len(text) < len(weights) or all(parts)


def test_split_by_weight(spark):
    df = spark.createDataFrame([("abcdefghij", [1.0, 3.0, 1.0]), ("ab", [1.0, 1.0, 1.0]), ("", [1.0, 2.0])], "t string, w array<double>")
    got = [r["p"] for r in df.select(S.split_by_weight(F.col("t"), F.col("w")).alias("p")).collect()]
    assert got == [["ab", "cdefgh", "ij"], ["ab", "", ""], ["", ""]]


def test_anchors_are_parts_of_the_text(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdef", k=rng.randint(1, 14))) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind, whole in (("title", 48), ("abstract", 96)):
        for r in df.select("t", S.anchors(F.col("t"), kind).alias("a")).collect():
            for a in r["a"]:
                assert r["t"][a["start"] : a["end"]] == a["text"]
                assert a["start"] == 0 or r["t"][a["start"] - 1] == " "
                assert a["end"] == len(r["t"]) or r["t"][a["end"]] == " "
            assert len(r["a"]) == 1 if len(r["t"]) <= whole else 1 <= len(r["a"]) <= 3


def test_match_over_a_line_break(spark):
    """A passage that two pages share is found across them (FX6)."""
    lines = spark.createDataFrame([(0, 0, 0, "Cross page ab-", 40.0, 110.0), (0, 1, 1, "stract text continues", 40.0, 110.0)], "doc_id long, page long, k long, text string, x0 double, y0 double")
    index = align.region_index(lines, keys=["doc_id"])
    anchored = spark.createDataFrame([(0, "Cross page abstract text continues")], "doc_id long, t string").select("doc_id", T.strip_abstract_heading(F.col("t")).alias("target")).withColumn("anchors", S.anchors(F.col("target"), "abstract"))
    out = align.locate_in_region(index, anchored, on=["doc_id"], kind="abstract").first()
    assert out["coverage"] >= 0.85 and out["ks"] == [0, 1] and out["confidence"] == "high"


def test_ambiguous_targets_are_refused(spark):
    df = spark.createDataFrame([(1, "a", 0.9, 3, 5), (1, "b", 0.89, 3, 5), (2, "a", 0.9, 3, 5), (2, "b", 0.80, 3, 5)], "g int, id string, coverage double, matched int, lines int")
    assert [(r["g"], r["id"]) for r in align.unambiguous(df, keys=["g"], identity="id").collect()] == [(2, "a")]
