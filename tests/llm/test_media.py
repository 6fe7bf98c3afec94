import hashlib
import tarfile
import zlib

from pagewright.llm import media


def test_payload_and_image():
    assert media.payload_of(None) == (b"\xff" * 576, 0)
    for text in ("a", "x" * 576, "é" * 1000):
        payload, n = media.payload_of(text)
        assert len(payload) % 576 == 0 and payload[:n] == text.encode() and set(payload[n:]) <= {255}
        image = media.to_png(payload)
        assert media.from_png(image) == payload and media.png_header(image[: media.HEADER_BYTES]) == (576, len(payload) // 576, 8)
    assert len(media.payload_of("x" * 576)[0]) == 576


def test_members_are_ordinary_tar_entries_named_by_content(spark, odd_docs):
    rows = media.pack_media(odd_docs).collect()
    for r in rows:
        with tarfile.open(r["shard"].removeprefix("file://")) as t:
            member = next(m for m in t.getmembers() if m.name == r["digest"] + ".png")
            assert (member.offset_data, member.size) == (r["offset"], r["length"])
            assert hashlib.sha256(t.extractfile(member).read()).hexdigest() == r["digest"]


def test_odd_rows(odd_docs, empty_docs):
    texts = [(str(r["doc_id"]), r["text"]) for r in odd_docs.collect()]
    out = media.media_columns(odd_docs).collect()
    want = []
    for i, t in texts:
        payload, n = media.payload_of(t)
        want.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), media.features(payload)))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"]) for r in out) == sorted(want)
    by = {}
    for r in out:
        by.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["width"], r["height"], r["sample_bits"]))
    assert all(len(v) == 1 for v in by.values())
    assert media.media_columns(empty_docs).count() == 0


def test_shards_roll_over(tmp_path, monkeypatch):
    monkeypatch.setattr(media, "SHARD_BYTES", 2000)
    shards = media._Shards(f"file://{tmp_path}/shards")
    places = [shards.put(f"{i}.png", bytes([i]) * 900) for i in range(6)]
    shards.close()
    assert len({s for s, _ in places}) > 1
    assert all(media.read_range(s, o, 900) == bytes([i]) * 900 for i, (s, o) in enumerate(places))


def test_a_content_has_one_place_in_the_store(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(400)], "doc_id long, text string").repartition(16)
    rows = media.pack_media(docs).collect()
    assert len(rows) == 400 and len({(r["digest"], r["shard"], r["offset"], r["length"]) for r in rows}) == len({r["digest"] for r in rows}) == 7


def test_nulls_and_clashing_names(spark, odd_docs):
    rows = media.pack_media(odd_docs.limit(2)).selectExpr("*", "'clash' as width", "'clash' as feature", "'kept' as header", "'kept' as found")
    rows = rows.unionByName(rows.selectExpr("doc_id", "n_bytes", "digest", "cast(null as string) as shard", "offset", "length", "width", "feature", "header", "found"))
    out = media.with_features(media.with_header(rows)).collect()
    assert len(out) == 4 and all(r["header"] == r["found"] == "kept" for r in out)
    assert all((r["width"], r["feature"] is None) == ((None, True) if r["shard"] is None else (576, False)) for r in out)


def test_results_by_an_independent_way(spark, odd_docs):
    from collections import Counter
    from math import log2

    texts = {str(r["doc_id"]) + str(r["text"]): r["text"] for r in odd_docs.collect()}
    want = set()
    for text in texts.values():
        raw = (text or "").encode("utf-8")
        padded = raw
        while not padded or len(padded) % 576:
            padded += bytes([255])
        counts = Counter(padded)
        mode = min(v for v in counts if counts[v] == max(counts.values()))
        entropy = -sum(c / len(padded) * log2(c / len(padded)) for c in counts.values())
        want.add((len(raw), hashlib.sha256(padded).hexdigest(), f"mean={sum(padded) / len(padded):.4f}", f"{abs(entropy):.4f}", len(counts), mode))
    got = set()
    for r in media.media_columns(odd_docs).collect():
        f = dict(x.split("=") for x in r["feature"].split(";"))
        got.add((r["n_bytes"], r["payload_sha256"], f"mean={float(f['mean']):.4f}", f"{float(f['entropy']):.4f}", int(f["levels"]), int(f["mode"])))
    assert got == want
