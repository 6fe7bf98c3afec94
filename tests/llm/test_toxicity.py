import os
import random

import numpy as np
import pytest

from pagewright.llm import toxicity

BAD = ["zopfel", "quarnt", "vuxil", "wrompst"]  # no words of any list


def corpus(spark, n=1200, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = rng.choices(words, k=rng.randint(10, 80))
        for _ in range(2 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    out = toxicity.score_documents(docs, labels).collect()
    held = [r for r in out if r["doc_id"] % 2 == 1]
    right = sum(r["toxic"] == (r["doc_id"] % 5 == 0) for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r[c] <= 1 for r in out for c in ("p_kind1", "p_kind2", "p_kind3", "p_toxic"))


def test_later_models_see_earlier_categories(spark):
    docs, labels = corpus(spark)
    chain = toxicity.train(docs, labels)
    assert chain.categories == ["kind1", "kind2", "kind3", "toxic"] and [len(e) for e in chain.earlier] == [0, 1, 2, 3] and any(chain.earlier[3])


def test_kinds_are_groups_of_shared_features():
    # rows 0-29 share features 0-2, 30-49 features 3-5, 50-59 features 6-8; 60-199 lack the label
    own = [range(0, 3)] * 30 + [range(3, 6)] * 20 + [range(6, 9)] * 10 + [range(9, 12)] * 140
    x = toxicity._Sparse(np.repeat(np.arange(200), 3), np.concatenate([list(r) for r in own]), 200, 12, np.zeros((200, 0)))
    y = (np.arange(200) < 60).astype(int)
    assert toxicity.kinds_of(x, y).tolist() == [0] * 30 + [1] * 20 + [2] * 10 + [-1] * 140
    assert set(toxicity.kinds_of(x, np.zeros(200, int))) == {-1}


def test_held_out_rows_of_the_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("no tables here")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("pmod(xxhash64(doc_id), 2) = 1")
    out = toxicity.score_documents(docs, labels.join(held, "doc_id", "left_anti")).select("doc_id", "toxic")
    rows = out.join(held.withColumnRenamed("toxic", "label"), "doc_id").collect()
    hit = sum(r["toxic"] and r["label"] for r in rows)
    assert 2 * hit / (sum(r["toxic"] for r in rows) + sum(r["label"] for r in rows)) >= 0.7


def test_ids_of_other_types(spark):
    docs, labels = corpus(spark, 200)
    text_ids = lambda df: df.withColumn("doc_id", df["doc_id"].cast("string"))
    a = toxicity.score_documents(docs, labels).collect()
    b = toxicity.score_documents(text_ids(docs), text_ids(labels)).collect()
    assert len(b) == len(a) and sum(r["toxic"] for r in b) > 30


def test_logistic_fit_parts_two_groups():
    x = toxicity._Sparse(np.arange(100), np.arange(100) % 2, 100, 2, np.zeros((100, 0)))
    w = toxicity.fit_logistic(x, (np.arange(100) % 2).astype(float), np.ones(100))
    assert w[1] > 0.5 > -0.5 > w[0]


def test_features_of_a_long_text_are_those_of_all_words(monkeypatch):
    text = " ".join(f"word{i}" for i in range(3000))
    want = toxicity.features_of(text)
    monkeypatch.setattr(toxicity, "PART", 100)
    assert toxicity.features_of(text) == want and "word2999" in want


def test_odd_rows(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (None, 1), (6, None), (999, 1)], "doc_id long, toxic int")
    out = toxicity.score_documents(odd_docs, labels).collect()
    assert len(out) == odd_docs.count()
    assert toxicity.score_documents(empty_docs, labels).count() == 0
    none = toxicity.score_documents(odd_docs, labels.where("false")).collect()
    assert len(none) == odd_docs.count() and not any(r["toxic"] for r in none)
    same = toxicity.score_documents(odd_docs, spark.createDataFrame([(3, 0), (5, 0)], "doc_id long, toxic int")).collect()
    assert not any(r["toxic"] for r in same)
