import itertools
import random
import re

import numpy as np
import pytest

from pagewright.llm import mixing


def test_targets_share_all_words_under_the_cap():
    t = mixing.targets([10, 1000, 1000, 1000])
    assert t[0] == 30 and abs(sum(t) - 3010) < 1e-6
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    even = mixing.targets([100] * 6)
    assert even == pytest.approx([100 * 6 * w / 16 for w in (5, 2, 1, 5, 2, 1)])


def test_fit_comes_as_near_as_any_choice():
    rng = random.Random(2)
    for _ in range(400):
        lengths = np.array(sorted(rng.sample(range(0, 30), rng.randint(1, 5))))
        counts = np.array([rng.randint(1, 4) for _ in lengths])
        total = int((lengths * counts).sum())
        budget = rng.randint(0, total + 5)
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        sums = {int(np.dot(lengths, c)) for c in itertools.product(*[range(k + 1) for k in counts])}
        assert abs(int((lengths * take).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_fit_uses_the_window():
    lengths, counts = np.arange(1, 400), np.full(399, 50)
    for window in (10, 1000, 65_536):
        assert int((lengths * mixing.fit(lengths, counts, 1_234_567, window)).sum()) == 1_234_567


def test_odd_rows(odd_docs, empty_docs):
    rows = mixing.mixed_words(odd_docs, bucket_rows=1).collect()
    assert len(rows) == odd_docs.count()
    words = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in odd_docs.collect())
    assert sorted(r["size"] for r in rows) == words
    assert all(r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"] if r["size"] else r["taken"] == 0 for r in rows)
    assert mixing.mixed_words(empty_docs).count() == 0


@pytest.mark.parametrize("bucket_rows", [1, 7, 100_000])
def test_sources_come_near_their_targets(spark, bucket_rows):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * (5 if i % 3 else rng.randint(1, 60))), rng.choice(["a", "b", "c", None, "é"]) if i % 3 else "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_words(docs, bucket_rows=bucket_rows).toPandas().merge(docs.toPandas()[["doc_id", "source"]].fillna("null"), on="doc_id")
    g = out.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (g["size"] == g["source_size"]).all() and (abs(g["taken"] - g["target"]) <= 5).all() and abs(g["target"].sum() - g["size"].sum()) < 1e-3
    again = mixing.mixed_words(docs.repartition(5), bucket_rows=bucket_rows).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == out.sort_values("doc_id")["taken"].tolist()


def test_the_mix_repeats_rows(odd_docs):
    counts = mixing.mix(odd_docs, odd_docs.columns).where("size > 0").selectExpr("sum(copies)").first()[0]
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == counts
