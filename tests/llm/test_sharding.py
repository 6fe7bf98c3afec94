import random
import zlib

import numpy as np

from pagewright.llm import sharding


def brute(sizes, shards):
    """The smallest largest sum of contiguous parts."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    best = ends[1:].astype(float)
    for _ in range(shards - 1):
        best = np.array([min([best[j], *(max(best[i], ends[j + 1] - ends[i + 1]) for i in range(j))]) for j in range(len(sizes))])
    return int(best[-1])


def test_capacity_is_minimal_also_when_ranges_are_split(spark):
    rng = random.Random(3)
    for bits, nodes in ((16, 18), (2, 3), (1, 2)):
        groups = sorted({rng.randrange(-(2**63), 2**63) for _ in range(60)})
        sizes = [rng.choice([1, 5, 30, 100]) for _ in groups]
        df = spark.createDataFrame(list(zip(groups, sizes, strict=True)), "key long, bytes long")
        capacity, keys = sharding.plan_cuts(df, 7, bits, nodes)
        assert capacity == brute(sizes, 7), (bits, nodes)
        sums = np.zeros(7, int)
        for k, s in zip(groups, sizes, strict=True):
            sums[sum(k >= c for c in keys)] += s
        assert sums.max() <= capacity and sums.sum() == sum(sizes)


def check(docs, shards=24):
    rows = sharding.shard_documents(docs, shards=shards).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return rows


def test_odd_rows(odd_docs, empty_docs):
    rows = check(odd_docs)
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    assert len({r["shard"] for r in rows if texts[r["doc_id"]] == "plain words here"}) == 1
    assert sharding.shard_documents(empty_docs).count() == 0


def test_sizes_are_near_equal_beside_a_hot_group(spark):
    rng = random.Random(5)
    rows = [(i, "copy of one text" * 20 if i % 3 == 0 else "".join(rng.choices("abcdef ", k=rng.randrange(50, 400)))) for i in range(3000)]
    out = check(spark.createDataFrame(rows, "doc_id long, text string"))
    sums = np.zeros(24, int)
    for r in out:
        sums[r["shard"]] += r["size"]
    rest = np.sort(sums)[:-1]
    assert rest.max() - rest.min() < 2 * 408 and len({r["shard"] for r in out if r["doc_id"] % 3 == 0}) == 1


def test_same_result_again(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, sharding.shard_documents(docs).collect())) == sorted(map(tuple, sharding.shard_documents(docs.repartition(7)).collect()))
