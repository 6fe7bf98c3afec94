"""SimHash near-duplicates through covering locality-sensitive hashing.

Every bit position gets one of the non-zero vectors of F_2^(r+1), evenly; for each
non-zero vector v a table keeps the bits whose vector has odd product with v. For at
most r differing bits some v is orthogonal to all their vectors, so the pair agrees on
everything that this table keeps: each pair within the radius meets in one of the
2^(r+1) - 1 tables at least, for certain.

Equal fingerprints are one node. Buckets give spanning links, not pairs. A bucket of more
than ``bucket_rows`` nodes is linked exactly another way: two fingerprints within r bits
become equal when one has at most ceil(r/2) and the other at most floor(r/2) bits
flipped, so flipped words are grouped and each node linked to the least node of its word,
a number of rows in proportion to the nodes. Links become components by alternating
star contractions on written tables. Nodes, links and rows are never broadcast but from
tables of ``BROADCAST_BYTES`` at most, whatever Spark takes for small enough: nothing that
grows is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pagewright.llm.batches import udf_of_lists
from pagewright.session import drop_table, input_bytes, write_table

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
BUCKET_ROWS = 32_768
#: Tables up to this size in files, some 30,000 fingerprints, may be broadcast.
BROADCAST_BYTES = 1 << 18
#: Shingles that are hashed and counted at once.
BLOCK = 16_384


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of the whole text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII white space parts
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    stops = ends[-n:]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK].tolist(), stops[at : at + BLOCK].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering tables' masks, signed."""
    n = 2 ** (radius + 1) - 1
    return [_signed(sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() % 2)) for v in range(1, n + 1)]


def _flips(free: int, most: int) -> list[int]:
    """All words of at most ``most`` ones among the bits of ``free``."""
    at = [1 << i for i in range(BITS) if free >> i & 1]
    return [_signed(sum(c)) for k in range(most + 1) for c in combinations(at, k)]


def _spanning(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of each member to the least of its component in one bucket, as arrays."""
    left = np.unique(fps)
    froms, roots = [], []
    while len(left) > 1:
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            near = np.bitwise_count((left ^ todo.pop()).view(np.uint64)) <= radius
            if near.any():
                found, left = left[near], left[~near]
                froms.append(found)
                roots.append(np.full(len(found), root))
                todo += found.tolist()
    return froms, roots


def _bucket_links(radius: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for batch in _then_end(batches):
            now = carry if batch is None else batch.to_numpy(np.int64) if carry is None else np.concatenate([carry, batch.to_numpy(np.int64)])
            if now is None or not len(now):
                continue
            starts = np.concatenate([[0], np.flatnonzero((now[1:, :2] != now[:-1, :2]).any(axis=1)) + 1, [len(now)]])
            if batch is not None:  # the last bucket may go on
                carry, now, starts = now[starts[-2] :], now[: starts[-2]], starts[:-1]
            sizes, fps, froms, roots = np.diff(starts), now[:, 2], [], []
            two = starts[:-1][sizes == 2]
            a, b = fps[two], fps[two + 1]
            near = (np.bitwise_count((a ^ b).view(np.uint64)) <= radius) & (a != b)
            froms.append(np.maximum(a, b)[near])
            roots.append(np.minimum(a, b)[near])
            for i in np.flatnonzero(sizes > 2):
                f, r = _spanning(fps[starts[i] : starts[i + 1]], radius)
                froms += f
                roots += r
            yield pd.DataFrame({"a": np.concatenate(froms), "b": np.concatenate(roots)})

    return links


def _then_end(batches):
    yield from batches
    yield None


def _merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that must be a merge join unless what ``df`` reads is small."""
    return df if input_bytes(df) <= BROADCAST_BYTES else df.hint("merge")


def near_links(nodes: DataFrame, *, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b), b < a, that span the graph of distinct ``nodes`` (fp) within the radius.

    The keys of hot buckets, 15 / ``bucket_rows`` of the nodes at most, are written first and
    broadcast where there are any. Nothing else is left to Spark's estimate: it takes the nodes
    under all masks for as small as the nodes, and would gather them on the driver. The result
    reads that table.
    """
    tables = masks(radius)
    keyed = nodes.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(tables)])).alias("x"), "fp").select("x.t", "x.key", "fp")
    hot = write_table(keyed.groupBy("t", "key").count().where(F.col("count") > bucket_rows).select("t", "key"), "hot", 1)
    linked = lambda usual: usual.repartition("t", "key").sortWithinPartitions("t", "key").select("t", "key", "fp").mapInPandas(_bucket_links(radius), "a long, b long")
    if hot.isEmpty():
        drop_table(hot)
        return linked(keyed).distinct()
    spark, half = nodes.sparkSession, radius // 2
    flips = spark.createDataFrame([(t, x, k < sum(1 for y in _flips(~m & (2**64 - 1), half))) for t, m in enumerate(tables) for k, x in enumerate(_flips(~m & (2**64 - 1), radius - half))], "t int, flip long, few boolean")
    words = keyed.join(F.broadcast(hot), ["t", "key"]).join(F.broadcast(flips), "t").select("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"), "fp", "few")
    roots = words.where("few").groupBy("t", "word").agg(F.min("fp").alias("root"))
    hot_links = words.join(roots.hint("merge"), ["t", "word"]).where("fp <> root").select(F.greatest("fp", "root").alias("a"), F.least("fp", "root").alias("b"))
    out = linked(keyed.join(F.broadcast(hot), ["t", "key"], "left_anti")).union(hot_links).distinct()
    out._pagewright_path = hot._pagewright_path
    return out


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root being the least node reachable.

    Large-star and small-star contractions alternate until the links no longer change.
    Roots themselves are absent, as are nodes that no link names.
    """
    written = lambda df, name: write_table(df, name, 1)  # noqa: E731  narrow tables of many rounds: few files
    same = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = written(links.select("a", "b"), "links")
    mark = same(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.join(_merged(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lower = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(_merged(lower), "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
        after = written(small.where("a <> b").distinct(), "links")
        for old in (now, least, large):
            drop_table(old)
        now, before, mark = after, mark, same(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    out = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    out._pagewright_path = now._pagewright_path  # dropping the result drops the links it reads
    return out


def fingerprints(docs: DataFrame, *columns: Column, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, ``columns`` and fp (signed) of every row."""
    fp = udf_of_lists(LongType(), lambda batches: ([fingerprint(x, size, seed) for x in batch] for batch in batches))
    return docs.select("doc_id", *columns, fp(F.coalesce(F.col("text"), F.lit(""))).alias("fp"))


def rooted(found: DataFrame, *, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """fp, root (the least fp of its component) and least (its least doc_id) of each fingerprint of ``found`` (doc_id, fp)."""
    nodes = write_table(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = near_links(nodes.select("fp"), radius=radius, bucket_rows=bucket_rows)
    roots = components(links)
    out = write_table(nodes.join(_merged(roots), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    drop_table(nodes, links, roots)
    return out


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, size: int = SHINGLE, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``.

    component_id is the least doc_id among all documents that links of at most ``radius``
    differing bits reach, the document itself included. Null and blank texts have
    fingerprint zero and link like any other; a null doc_id has a row, but is never a
    component's id unless it has no other. Repeated rows give a row each. Only doc_id and
    text are read. The result reads two written tables, fingerprints and named.
    """
    found = write_table(fingerprints(docs, size=size, seed=seed), "fingerprints")
    nodes = rooted(found, radius=radius, bucket_rows=bucket_rows)
    least = write_table(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "leasts")  # read back, so that a large component's rows can be split
    named = write_table(nodes.join(_merged(least), "root").select("fp", "component_id"), "named")
    drop_table(nodes, least)
    return found.join(_merged(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
