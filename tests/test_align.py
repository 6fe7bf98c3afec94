import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import align

ZH = "这是一段没有空格的中文摘要，用来检验候选对的数量不会因为它而改变，并且能在正文里找到它的位置。" * 3


def passages(spark, extra=()):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9)))
    rows = [(i, " ".join(["in", "this", "paper", "we", *(word() for _ in range(40))])) for i in range(12)]
    return spark.createDataFrame([*rows, *extra], "item_id long, text string"), rows


def documents(spark, rows):
    rng = random.Random(6)
    filler = lambda: " ".join("".join(rng.choices("qrstuvwxyz", k=5)) for _ in range(30))
    docs = [(i, f"{filler()} in this paper we {filler()} {rows[i][1] if i < len(rows) else ''} {filler()}") for i in range(40)]
    docs += [(100, f"{filler()}前言{ZH}后记"), (101, None), (102, "")]
    return spark.createDataFrame(docs, "doc_id long, text string")


def pairs(docs, items):
    texts = docs.select("doc_id", T.normalize_front_matter(F.col("text"), False, False).alias("text"))
    found = align.passage_anchors(items, compose=False, numeric=False).where(F.size("anchors") > 0)
    return {tuple(r) for r in align.candidates(texts, found).collect()}


def test_common_beginnings_and_texts_without_spaces_bring_no_more_pairs(spark):
    items, rows = passages(spark)
    docs = documents(spark, rows)
    own = {(i, i) for i in range(12)}
    assert pairs(docs, items) == own
    more, _ = passages(spark, [(99, ZH), (98, "averylongtitleofoneword"), (97, "")])
    assert pairs(docs, more) == own | {(100, 99)}


def test_passages_are_found_with_and_without_spaces(spark):
    items, rows = passages(spark, [(99, ZH)])
    out = {r["doc_id"]: (r["item_id"], r["confidence"]) for r in align.align(documents(spark, rows), items, compose=False, numeric=False).collect()}
    assert out == {i: (i, "high") for i in range(12)} | {100: (99, "high")}


def test_defaults_give_the_same_as_without_composition(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert sorted(map(tuple, align.align(docs, items).collect())) == sorted(map(tuple, align.align(docs, items, compose=False, numeric=False).collect()))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")]])
def test_no_passages(spark, rows):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert align.align(docs, spark.createDataFrame(rows, "item_id long, text string")).count() == 0
