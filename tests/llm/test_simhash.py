import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import simhash


def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    comp = ids.copy()
    while True:
        new = np.array([comp[n].min() for n in near])
        if (new == comp).all():
            return comp
        comp = new


@given(st.text(alphabet="aB \n\tÉ\x0b\xa0z", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


def test_fingerprint_over_blocks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text) == want and want % 2**64 == brute_fingerprint(text)


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
@settings(max_examples=400)
def test_every_near_pair_meets(x, flips):
    y = x
    for b in set(flips):
        y ^= 1 << b
    assert any((x ^ y) & (m % 2**64) == 0 for m in simhash.masks())


def clustered(n, seed):
    rng = random.Random(seed)
    centers = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        x = rng.choice(centers) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_links_and_components_are_exact_with_and_without_hot_buckets(spark):
    fps = clustered(300, 1)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(np.array(fps, np.uint64), np.array(signed))
    for rows in (32_768, 3):
        links = simhash.near_links(nodes, bucket_rows=rows)
        of = dict(zip(signed, want.tolist(), strict=True))
        assert all(of[r["a"]] == of[r["b"]] and r["b"] < r["a"] for r in links.collect())
        found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
        assert [found.get(x, x) for x in signed] == want.tolist(), rows


def test_nodes_under_all_masks_are_never_broadcast(spark, tmp_path):
    spark.range(1000).selectExpr("xxhash64(id) as fp").write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))  # small enough on disk to be broadcast
    for rows in (32_768, 0):
        plan = str(simhash.near_links(nodes, bucket_rows=rows)._jdf.queryExecution().executedPlan()).split("\n")
        depth = [len(re.match(r"[\s:+-]*", x)[0]) for x in plan]
        for i, line in enumerate(plan):
            below = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            assert "BroadcastExchange" not in line or not any("Generate" in x for x in plan[i:below]), rows


def test_no_join_of_what_grows_is_a_broadcast(spark, sf_dir, monkeypatch):
    plans, write = [], simhash.write_table

    def spied(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *more)

    monkeypatch.setattr(simhash, "write_table", spied)
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", 0, raising=False)
    out = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))  # far below Spark's own limit
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)


def test_a_long_chain_is_one_component(spark):
    chain = [(i + 1, i) for i in range(200)]
    out = simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r["root"] for r in out} == {0} and {r["node"] for r in out} == set(range(1, 201))


def test_odd_rows(odd_docs, empty_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    out = simhash.near_duplicates(odd_docs).collect()
    assert len(out) == len(rows)
    assert sorted(r["fingerprint"] for r in out) == sorted(f"{brute_fingerprint(r['text']):016x}" for r in rows)
    comp = {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None}
    assert comp[0] == comp[1] == comp[2] == 0 and comp[3] == comp[4] == 3
    assert simhash.near_duplicates(empty_docs).count() == 0


def test_tables_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = simhash.near_duplicates(docs).toPandas().sort_values("doc_id")
    fps = np.array([int(x, 16) for x in out["fingerprint"]], np.uint64)
    assert brute_components(fps, out["doc_id"].to_numpy()).tolist() == out["component_id"].tolist()
