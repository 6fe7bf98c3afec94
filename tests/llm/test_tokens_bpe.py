import hashlib
import random

import numpy as np
import pytest

from pagewright.llm import bpe, tokens

ALPHABET = "ab the▁ \n\t éß中😀'.,<s>\x00\r  "


def texts(n, size, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_whole_tokens_are_proved_and_counts_are_the_librarys():
    c = tokens.counter(tokens.default_model())
    assert c.splits and len(c.proved) > 30_000
    for t in texts(3000, 20):
        assert c.count(t) == len(c.sp.encode(t)), t
    assert c.count(None) == 0


def test_counts_without_splits_fall_back_to_the_library():
    c = tokens.PieceCounter(tokens.default_model())
    c.splits = False
    assert c.count("some words here") == len(c.sp.encode("some words here"))


def test_count_tokens_on_odd_rows(spark, odd_docs, empty_docs):
    c = tokens.counter(tokens.default_model())
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(c.sp.encode(r["text"] or ""))) for r in odd_docs.collect())
    got = tokens.count_tokens(odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got) and any(r["over_limit"] for r in got)
    assert tokens.count_tokens(empty_docs).count() == 0


def test_parts_are_safe_places():
    enc = bpe.encoding(bpe.default_ranks())
    for t in texts(1500, 80, 2):
        parts = list(bpe.parts(t, 7))
        assert "".join(parts) == t
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t), t


def test_encode_decode_on_odd_rows(spark, odd_docs, empty_docs):
    enc = bpe.encoding(bpe.default_ranks())
    want = []
    for r in odd_docs.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want.append((str(r["doc_id"]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = bpe.encode_decode(odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert all(r["round_trip"] for r in got)
    assert bpe.encode_decode(empty_docs).count() == 0


def test_ids_decode_to_the_texts_bytes(spark, odd_docs):
    out = bpe.decode(bpe.encode(odd_docs)).collect()
    assert sorted(bytes(r["decoded"]) for r in out) == sorted((r["text"] or "").encode() for r in odd_docs.collect())


@pytest.mark.parametrize("ids", [[50_000], [1, 2, 3]])
def test_parts_of_characters_stay_raw(ids):
    enc = bpe.encoding(bpe.default_ranks())
    assert bpe.decode_ids(enc, np.array(ids, "<u4")) == b"".join(enc.decode_single_token_bytes(i) for i in ids)
