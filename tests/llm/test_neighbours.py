import random

import numpy as np

from pagewright.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(vectors, k=5, every=50):
    ids = sorted(i for i, v in vectors.items())
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            s = x @ x[n] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[n]))
            out[i] = [(ids[j], s[j]) for j in sorted(range(len(ids)), key=lambda j: (-round(s[j], 12), ids[j])) if j != n][:k]
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", "x") for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(neighbours.search(df, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_rotation_keeps_angles():
    x = np.random.default_rng(1).normal(size=(20, 50))
    y = neighbours.rotate(x, 0, 0)
    assert np.allclose(x @ x.T, y @ y.T) and y.shape == (20, 64)


def test_all_buckets_give_the_exact_answer(spark):
    rng = random.Random(7)
    vectors = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(200)}
    vectors |= {i: vectors[50] for i in range(200, 320)}  # copies of a query, and two queries among them
    vectors |= {400: [2 * v for v in vectors[3]], 401: vectors[3]}
    vectors = {i: np.float32(v).tolist() for i, v in vectors.items()}
    for options in ({}, {"cell_rows": 20}, {"bucket": 8}):
        got, want = found(spark, list(vectors.items()), **options), brute(vectors)
        assert got.keys() == want.keys()
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
            assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_no_query_lacks_rows_that_there_are(spark):
    rng = np.random.default_rng(11)
    centre = 4 * rng.normal(size=64)
    near = {i: centre + rng.normal(size=64) for i in range(1, 300) if i % 50}
    far = {50 * i: -centre + 3 * rng.normal(size=64) for i in range(3)}
    few = {1000 + i: rng.normal(size=48) for i in range(4)} | {1050: rng.normal(size=48)}
    for options in ({}, {"cell_rows": 2}):
        got = found(spark, [(i, np.float32(v).tolist()) for i, v in (near | far | few).items()], **options)
        for vectors in (near | far, few):
            want = brute({i: np.float32(v).tolist() for i, v in vectors.items()})
            for q in want:
                assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert len(got) == 5


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, []), (50, None), (100, [1.0, 2.0, 3.0])]
    got = found(spark, rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [6]}
    assert found(spark, []) == {}


def test_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute({r["vec_id"]: r["embedding"] for r in df.collect()})
    got = {}
    for r in neighbours.search(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(len(w) for w in want.values())


def test_recall_with_two_hashes():
    x = np.random.default_rng(3).normal(size=(20_000, 64)) + 3 * np.random.default_rng(4).normal(size=(10, 64))[np.arange(20_000) % 10]
    u = neighbours.unit(x)
    q = u[:100]
    near = q @ u.T
    near[np.arange(100), np.arange(100)] = -2
    top = np.argsort(-near, axis=1)[:, :5]
    hit = np.zeros(top.shape, bool)
    for t in range(neighbours.TABLES):
        first, second = divmod(neighbours.codes_of(u, t, 2)[top], 128)
        mask = neighbours.masks_of(q, t, 2, neighbours.AXES)
        hit |= np.take_along_axis(mask[:, 0], first, 1) & np.take_along_axis(mask[:, 1], second, 1)
    assert hit.mean() >= 0.9


def test_rounding_stays_within_its_bound():
    u = neighbours.unit(np.random.default_rng(5).normal(size=(500, 48)))
    v, scale, moved = neighbours.rounded(u)
    near = (v * scale[:, None]).astype(np.float32) @ (v * scale[:, None]).astype(np.float32).T
    assert (np.abs(near - u @ u.T) <= moved[:, None] + moved[None, :]).all()


def test_few_opposite_and_orthogonal_vectors(spark):
    rng = np.random.default_rng(8)
    v, w = rng.normal(size=64), rng.normal(size=64)
    for vectors in ({0: v, 50: -v, 1: w}, {i: rng.normal(size=64) for i in range(2)}, {i: rng.normal(size=64) for i in range(6)}):
        vectors = {i: np.float32(x).tolist() for i, x in vectors.items()}
        got, want = found(spark, list(vectors.items())), brute(vectors)
        assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    got = found(spark, [(i, x.tolist()) for i, x in enumerate(np.eye(64))])
    assert {q: [s for _, s in x] for q, x in got.items()} == {0: [0.0] * 5, 50: [0.0] * 5}


def test_an_id_with_several_vectors(spark):
    got = found(spark, [(6, [1.0, 1.0]), (6, [1.0, 2.0]), (6, [1.0, 1.0]), (50, [1.0, 1.5]), (7, [-1.0, 0.0])])
    assert [i for i, _ in got[50]] == [6, 6, 7]
