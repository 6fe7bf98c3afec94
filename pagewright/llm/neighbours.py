"""Approximate nearest neighbours by cosine, through cross-polytope hashing.

A hash turns a unit vector by three rounds of random signs and a fast Hadamard transform
and takes the nearest signed axis; a table's code joins ``hashes`` of them. Every vector
stands under one code in each table. A query looks under every code that its ``axes`` most
likely axes of each hash make, so a hash more narrows the candidates without another row
being sent: codes lie together in cells by ranges of their first axis, a query goes once to
each cell that it has codes in, and a mask of axes goes with it.

Cells hold vectors rounded to a byte a component with the distance that this moved them.
The bounds this gives on each cosine decide what cannot be among the k nearest of its cell;
what is left is scored exactly, in double precision, on the original vectors. No candidate
is lost by the rounding.

Equal vectors are one class with its smallest ids, of which no more than k + 1 can matter,
and each distinct query vector is searched once, so copies cost nothing. A cell of more
than ``cell_rows`` classes or queries is split by hash into blocks and parts that meet each
other, none left out. A query for which the codes hold fewer classes than it could have is
compared with all rows of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pagewright.session import write_table

K, EVERY = 5, 50
TABLES, AXES, SEED = 2, 56, 5
#: Classes that a code should hold, on average.
BUCKET = 256
#: Classes or queries of a cell before it is split.
CELL_ROWS = 262_144
#: Queries compared at once.
CHUNK = 1_024


@lru_cache(maxsize=64)
def _signs(dim: int, table: int, hash_: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, table, hash_, dim]).choice([-1.0, 1.0], (3, dim))


def turned_dim(d: int) -> int:
    """Components after padding to a power of two, 4 at least."""
    return max(4, 1 << (int(d) - 1).bit_length())


def rotate(x: np.ndarray, table: int, hash_: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-rotation of the rows of ``x``, padded to a power of two."""
    dim = turned_dim(x.shape[1])
    y = np.zeros((len(x), dim))
    y[:, : x.shape[1]] = x
    for signs in _signs(dim, table, hash_, seed):
        y = y * signs
        h = 1
        while h < dim:
            y = y.reshape(len(x), -1, 2, h)
            y = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), dim)
            h *= 2
        y /= np.sqrt(dim)
    return y


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def signed_axes(x: np.ndarray, table: int, hash_: int, most: int, seed: int = SEED) -> np.ndarray:
    """The ``most`` nearest signed axes of each row, nearest first: twice the axis, plus one where it points back."""
    y = rotate(x, table, hash_, seed)
    axes = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :most]
    return axes * 2 + (np.take_along_axis(y, axes, 1) < 0)


def codes_of(x: np.ndarray, table: int, hashes: int, seed: int = SEED) -> np.ndarray:
    """The code of each row in a table."""
    width, code = 2 * turned_dim(x.shape[1]), np.zeros(len(x), np.int64)
    for h in range(hashes):
        code = code * width + signed_axes(x, table, h, 1, seed)[:, 0]
    return code


def masks_of(x: np.ndarray, table: int, hashes: int, axes: int, seed: int = SEED) -> np.ndarray:
    """For each row and hash, which signed axes it looks under (booleans)."""
    out = np.zeros((len(x), hashes, 2 * turned_dim(x.shape[1])), bool)
    for h in range(hashes):
        np.put_along_axis(out[:, h], signed_axes(x, table, h, axes, seed), True, axis=1)
    return out


def hashes_for(n: int, d: int, bucket: int = BUCKET) -> int:
    """Hashes a code so that about ``bucket`` of ``n`` vectors share one."""
    return max(1, round(log(max(n / bucket, 1)) / log(2 * turned_dim(d))))


def rounded(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in bytes: components, their scale, and a bound on the distance moved."""
    scale = (np.abs(u).max(axis=1) / 127).astype(np.float32)
    v = np.rint(u / scale[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
    moved = np.linalg.norm(u - v * scale[:, None].astype(np.float64), axis=1)
    return v, scale, (moved + 2e-5).astype(np.float32)  # and what single precision may add


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


class _Cell:
    """The candidates of a cell by code, and the search in them."""

    def __init__(self, rows: pd.DataFrame, width: int):
        rows = rows.sort_values("code", kind="stable")
        self.cid, self.moved, self.width = rows["cid"].to_numpy(), rows["moved"].to_numpy(np.float32), width
        self.v = np.frombuffer(b"".join(rows["v"]), np.int8).reshape(len(rows), -1)
        self.scale = rows["scale"].to_numpy(np.float32)
        code = rows["code"].to_numpy()
        self.starts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]])
        self.codes = code[self.starts[:-1]]

    def best(self, asked: pd.DataFrame, n: int) -> Iterator[pd.DataFrame]:
        """(q, c, low, high) of all that may be among the ``n`` nearest of a query in this cell."""
        for at in range(0, len(asked), CHUNK):
            part = asked.iloc[at : at + CHUNK]
            q = np.frombuffer(b"".join(part["v"]), np.int8).reshape(len(part), -1).astype(np.float32) * part["scale"].to_numpy(np.float32)[:, None]
            mask = np.unpackbits(np.frombuffer(b"".join(part["mask"]), np.uint8).reshape(len(part), -1), axis=1, bitorder="little").astype(bool)
            hashes, slack = mask.shape[1] // self.width, part["moved"].to_numpy(np.float32)
            least = np.full(len(part), -3, np.float32)  # what the n-th best certainly reaches
            found = [np.empty((0,), np.int64), np.empty((0,), np.int64), np.empty((0,), np.float32)]
            news = []
            for code, a, b in zip(self.codes.tolist(), self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
                looks = np.ones(len(part), bool)
                for h in range(hashes - 1, -1, -1):
                    code, axis = divmod(code, self.width)
                    looks &= mask[:, h * self.width + axis]
                who = np.flatnonzero(looks)
                if not len(who):
                    continue
                near = q[who] @ (self.v[a:b].astype(np.float32) * self.scale[a:b, None]).T
                margin = slack[who] + self.moved[a:b].max()
                if b - a >= n:
                    new = np.flatnonzero(least[who] < -2)
                    least[who[new]] = np.partition(near[new], b - a - n, axis=1)[:, b - a - n] - margin[new]
                i, j = np.nonzero(near >= (least[who] - margin)[:, None])
                news.append((who[i], j + a, near[i, j]))
                if sum(len(x[0]) for x in news) > 64 * n * len(part):
                    found, news = self._pruned(found, news, slack, least, n), []
            rows, cols, near = self._pruned(found, news, slack, least, n)
            margin = slack[rows] + self.moved[cols]
            yield pd.DataFrame({"q": part["cid"].to_numpy()[rows], "c": self.cid[cols], "low": near - margin, "high": near + margin})

    def _pruned(self, found, news, slack, least, n):
        rows, cols, near = (np.concatenate(x) for x in zip(found, *news, strict=True))
        low = near - slack[rows] - self.moved[cols]
        order = np.lexsort((-low, rows))
        rows, cols, near, low = rows[order], cols[order], near[order], low[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        least[rows[nth == n - 1]] = np.maximum(least[rows[nth == n - 1]], low[nth == n - 1])
        keep = near + slack[rows] + self.moved[cols] >= least[rows]
        return rows[keep], cols[keep], near[keep]


def _in_cells(n: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, cell = None, [], None
        for batch in batches:
            keys = batch[["d", "t", "cell", "block", "part", "asks"]].to_numpy(np.int64)
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                key, rows = tuple(keys[a, :5]), batch.iloc[a:b]
                if key != now:
                    now, held, cell = key, [], None
                if not keys[a, 5]:
                    held.append(rows)
                elif held or cell:
                    if cell is None:
                        cell, held = _Cell(pd.concat(held), 2 * turned_dim(key[0])), []
                    yield from cell.best(rows, n)

    return search


@F.pandas_udf(DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of vectors of one length, in double precision."""
    out = np.empty(len(a))
    size = a.map(len).to_numpy()
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x, y = (_stacked(s.iloc[at]) for s in (a, b))
        x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
        out[at] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
    return pd.Series(out)


KEY = ["c1", "c2"]
CELL = ["d", "t", "cell"]
BYTES = "v binary, scale float, moved float"


def _cell_of(axis, cells: int, width: int):
    return axis * min(cells, width) // width


def _coded(valid: DataFrame, n: int, cells: int, tables: int, bucket: int, seed: int) -> DataFrame:
    """Rows with their bytes and codes instead of the embedding."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby(batch["embedding"].map(len)):
                u, width, hashes = unit(_stacked(part["embedding"])), 2 * turned_dim(d), hashes_for(n, d, bucket)
                v, scale, moved = rounded(u)
                codes = np.stack([codes_of(u, t, hashes, seed) for t in range(tables)], axis=1)
                in_cells = _cell_of(codes // width ** (hashes - 1), cells, width).astype(np.int32)
                yield part[["vec_id", *KEY]].assign(d=d, v=[x.tobytes() for x in v], scale=scale, moved=moved, codes=list(codes), cells=list(in_cells))

    return valid.mapInPandas(code, f"vec_id long, c1 long, c2 long, d int, {BYTES}, codes array<long>, cells array<int>")


def _visits(queries: DataFrame, n: int, cells: int, tables: int, axes: int | None, bucket: int, seed: int) -> DataFrame:
    """A row for each cell that a query goes to, with its masks; without ``axes`` all cells of one table."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby("d"):
                width, hashes = 2 * turned_dim(d), hashes_for(n, d, bucket)
                u = np.frombuffer(b"".join(part["v"]), np.int8).reshape(len(part), -1).astype(np.float64)
                of = _cell_of(np.arange(width), cells, width)
                for t in range(tables if axes else 1):
                    mask = masks_of(unit(u), t, hashes, axes, seed) if axes else np.ones((len(part), hashes, width), bool)
                    goes = np.zeros((len(part), of[-1] + 1), bool)
                    for axis in range(width):
                        goes[:, of[axis]] |= mask[:, 0, axis]
                    packed = np.packbits(mask.reshape(len(part), -1), axis=1, bitorder="little")
                    who, cell = np.nonzero(goes)
                    yield part.iloc[who][["d", "cid", "v", "scale", "moved"]].assign(t=t, cell=cell, mask=[packed[i].tobytes() for i in who])

    return queries.select("cid", "d", "v", "scale", "moved").mapInPandas(visit, f"d int, cid long, {BYTES}, t int, cell int, mask binary")


def _met(classes: DataFrame, visits: DataFrame, n: int, cell_rows: int, all_rows: int) -> DataFrame:
    """(q, c, low, high) of all that a cell says may be among the ``n`` nearest of a query."""
    placed = classes.select("d", "cid", "v", "scale", "moved", F.posexplode(F.arrays_zip("codes", "cells")).alias("t", "x")).select("d", "cid", "v", "scale", "moved", "t", "x.cells", "x.codes")
    placed = placed.withColumnsRenamed({"cells": "cell", "codes": "code"})
    count = lambda df, name: df.groupBy(*CELL).agg(F.ceil(F.count("*") / cell_rows).cast("int").alias(name))
    if all_rows > cell_rows:
        large = write_table(count(placed.select(*CELL), "blocks").join(count(visits.select(*CELL), "parts"), CELL).where("blocks > 1 or parts > 1"), "large-cells")
        placed, visits = placed.join(large, CELL, "left"), visits.join(large, CELL, "left")
    else:  # no cell can be larger
        placed, visits = (df.withColumns({"blocks": F.lit(1), "parts": F.lit(1)}) for df in (placed, visits))
    nth = lambda name: F.coalesce(name, F.lit(1))
    all_of = lambda name: F.explode(F.sequence(F.lit(0), nth(name) - 1))
    own = lambda name: F.pmod(F.xxhash64("cid"), nth(name)).cast("int")
    cols = [*CELL, "block", "part", "asks", "cid", "v", "scale", "moved", "code", "mask"]
    held = placed.withColumn("block", own("blocks")).withColumn("part", all_of("parts")).withColumn("asks", F.lit(0)).withColumn("mask", F.lit(None).cast("binary"))
    asking = visits.withColumn("part", own("parts")).withColumn("block", all_of("blocks")).withColumn("asks", F.lit(1)).withColumn("code", F.lit(-1).cast("long"))
    at = [*CELL, "block", "part"]
    met = held.select(*cols).union(asking.select(*cols)).repartition(*at).sortWithinPartitions(*at, "asks")
    return met.mapInPandas(_in_cells(n), "q long, c long, low float, high float")


def _survivors(met: DataFrame, n: int, name: str) -> DataFrame:
    """Each (q, c) once that all of a query's cells together leave among its ``n`` nearest; written."""
    once = met.repartition("q").groupBy("q", "c").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    nth = once.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low"))))
    sure = F.max(F.when(F.col("nth") == n, F.col("low"))).over(Window.partitionBy("q"))
    return write_table(nth.withColumn("sure", sure).where("sure is null or high >= sure").select("q", "c"), name)


def search(vectors: DataFrame, *, k: int = K, every: int = EVERY, tables: int = TABLES, axes: int = AXES, bucket: int = BUCKET, cell_rows: int = CELL_ROWS, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose vec_id is a multiple of ``every``.

    ``vectors`` has vec_id and embedding. Nearest first, equal scores by smaller vec_id; a
    query's own row is left out, equal vectors of other ids are not. Rows with null vec_id,
    null, empty or zero embedding, or a null or non-finite component take no part, nor do
    vectors whose length no other shares find partners. Repeated rows count once. A query
    has fewer than ``k`` rows only where its length has no more candidates. Empty input
    gives no rows. Other columns are not read.
    """
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & good)
    as_double = F.col("embedding").cast("array<double>")
    valid = valid.select("vec_id", "embedding", F.xxhash64(as_double).alias("c1"), F.xxhash64(F.lit(seed), F.reverse(as_double)).alias("c2"))
    n, cores = valid.count(), vectors.sparkSession.sparkContext.defaultParallelism
    cells = 1 << max(0, ceil(log(max(n / cell_rows, 4 * cores / tables, 1), 2)))

    # classes of equal vectors: their least ids, and the bytes of one of them
    ids = valid.select(*KEY, "vec_id").distinct().withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    ids = ids.groupBy(*KEY).agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(*KEY, F.col("ids")[0].alias("vec_id"), "ids")  # k + 1 at most
    coded = _coded(valid, n, cells, tables, bucket, seed).dropDuplicates([*KEY, "vec_id"])
    classes = write_table(coded.join(ids, [*KEY, "vec_id"]).select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
    asks = valid.where(F.col("vec_id") % every == 0).select(*KEY, F.col("vec_id").alias("query_id")).distinct()
    asked = write_table(asks.join(classes.select(*KEY, "cid", "d"), KEY).select(F.col("cid").alias("q"), "query_id"), "asked")
    queries = classes.join(asked.select(F.col("q").alias("cid")), "cid", "left_semi")

    pairs = _survivors(_met(classes, _visits(queries, n, cells, tables, axes, bucket, seed), k + 1, cell_rows, n), k + 1, "near")
    # what the codes did not fill is compared with everything of its length
    most = classes.groupBy("d").agg(F.least(F.count("*"), F.lit(k + 1)).alias("most"))
    got = pairs.groupBy(F.col("q").alias("cid")).agg(F.count("*").alias("got"))
    lacking = queries.join(got, "cid", "left").join(most, "d").where(F.coalesce("got", F.lit(0)) < F.col("most"))
    if not lacking.isEmpty():
        short = write_table(lacking.select("cid", "d", "v", "scale", "moved"), "short")
        one = classes.withColumn("codes", F.slice("codes", 1, 1)).withColumn("cells", F.slice("cells", 1, 1))
        more = _survivors(_met(one, _visits(short, n, cells, tables, None, bucket, seed), k + 1, cell_rows, n), k + 1, "filled")
        pairs = pairs.join(short.select(F.col("cid").alias("q")), "q", "left_anti").union(more)

    # exact scores, on the vectors of the classes that are left
    wanted = pairs.select(F.col("c").alias("cid")).union(pairs.select(F.col("q").alias("cid"))).distinct().join(classes.select("cid", *KEY, "vec_id"), "cid")
    exact = write_table(valid.join(wanted, [*KEY, "vec_id"]).select("cid", "embedding").dropDuplicates(["cid"]), "exact")
    scored = pairs.join(exact.select(F.col("cid").alias("c"), F.col("embedding").alias("a")), "c").join(exact.select(F.col("cid").alias("q"), F.col("embedding").alias("b")), "q")
    best = scored.select("q", "c", cosine("a", "b").alias("score")).join(classes.select(F.col("cid").alias("c"), "ids"), "c")
    nth = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    top = best.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k + 1).select("q", "score", F.explode("ids").alias("vec_id"))
    top = top.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= k + 1)
    lists = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))  # k + 1 at most
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return asked.join(lists, "q").select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
