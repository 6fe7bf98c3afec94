"""Mixing sources to target weights by fitting word budgets.

Targets: sources in code-point order, null last, have the weights 5, 2, 1 in turn and
share all words; a target stops at ``most`` times its source's size and the excess is
shared again among the others.

A source gives whole copies first; for the rest of its budget its documents are counted by
exact length. A share of each length is taken in proportion, long ones then fill up to a
window, and a bounded knapsack over the window finds the numbers a length that meet the
budget, or come nearest. Which documents of a length are taken follows a seeded hash.

The histogram has a row for each source and distinct length. Documents are ranked in
buckets of about ``bucket_rows``: whole buckets are taken until the one where the number
is reached, so neither a hot source nor a length that many documents share is sorted in
one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import drop_table, write_table

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 17
WORD = r"[^\x20\x09-\x0D]+"
WINDOW, BUCKET_ROWS = 65_536, 2_048


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """The target of each source, in order; their sum is that of the sizes."""
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    size, out = np.array(sizes, float), np.zeros(len(sizes))
    open_ = np.ones(len(sizes), bool)
    while open_.any():
        rest = size.sum() - out[~open_].sum()
        out[open_] = rest * weight[open_] / weight[open_].sum()
        above = open_ & (out > most * size)
        if not above.any():
            break
        out[above] = most * size[above]
        open_ &= ~above
    return out.tolist()


def _filled(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, budget: int) -> np.ndarray:
    """``take`` and more documents, so that the words come nearest to ``budget``; the lesser sum of two as near.

    A bounded knapsack: the numbers left of each length are 0/1 items by binary splitting, and
    a bit set holds the sums that the items so far reach. A sum above the budget can only win
    within twice what is left.
    """
    take = take.copy()
    rest = budget - int((lengths * take).sum())
    items = []
    for i in np.argsort(-lengths, kind="stable"):
        left, m = min(int(counts[i] - take[i]), 2 * rest // int(lengths[i])) if lengths[i] else 0, 1
        while left > 0:
            m = min(m, left)
            items.append((int(lengths[i]) * m, int(i), m))
            left, m = left - m, m * 2
    reach, full, by = 1, (1 << (2 * rest + 1)) - 1, np.full(2 * rest + 1, -1, np.int32)
    for k, (w, _, _) in enumerate(items):
        new = (reach << w) & full & ~reach
        if new:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(2 * rest // 8 + 1, "little"), np.uint8), bitorder="little"))
            by[at] = k
            reach |= new
            if new >> rest & 1:
                break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    over = (above & -above).bit_length() if above else rest + 1
    at = rest + over if over < rest - below else below
    while at:
        w, i, m = items[by[at]]
        take[i] += m
        at -= w
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take for ``budget`` words.

    A share of each length is taken in proportion, long ones then fill up to ``window``, and the
    knapsack fills the rest. A budget up to ``window`` that this does not meet is fitted again
    without the share: the result is then the nearest sum that there is. For larger ones it is
    the nearest to be had above the share, with a window of documents to choose from.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest > window and lengths[i]:
            more = min(int(counts[i] - take[i]), (rest - window) // int(lengths[i]))
            take[i] += more
            rest -= more * int(lengths[i])
    missed = lambda x: abs(int((lengths * x).sum()) - budget)
    found = _filled(lengths, counts, take, budget)
    if missed(found) and budget <= window:
        found = min(found, _filled(lengths, counts, np.zeros(len(lengths), np.int64), budget), key=missed)
    return found


def mix(docs: DataFrame, carry: list[str], *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, window: int = WINDOW, bucket_rows: int = BUCKET_ROWS, keep_rows: bool = True) -> DataFrame:
    """Struct ``row`` of the ``carry`` columns, size, source_size, target, copies of every row.

    A document is taken ``copies`` times, at most ``most``; words are maximal runs other
    than ASCII white space; null text has none and is taken no time, as is blank text.
    Null is a source of its own. Repeated rows count each; where only some of them are
    taken, which ones does not matter. ``keep_rows`` writes the counted rows, so that texts
    are read once; without it they are counted twice.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*carry).alias("row"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("h"))
    if keep_rows:
        rows = write_table(rows, "mix-rows")
    hist = write_table(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    found = sorted(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n"))).collect(), key=lambda r: (r[0] is None, (r[0] or "").encode()))  # a row for each source
    wanted = dict(zip([r[0] for r in found], zip(targets([r[1] for r in found], weights, most), [r[1] for r in found], strict=True), strict=True))

    def plan(lengths: pd.DataFrame) -> pd.DataFrame:
        source = lengths["source"].iloc[0]
        target, size = wanted[None if pd.isna(source) else source]
        budget = round(target)
        copies = min(budget // size, most) if size else 0
        lengths = lengths.sort_values("size")
        extra = fit(lengths["size"].to_numpy(np.int64), lengths["n"].to_numpy(np.int64), budget - copies * size, window) if copies < most else np.zeros(len(lengths), np.int64)
        return lengths.assign(source_size=size, target=float(target), whole=copies, extra=extra)

    kind = "source string, size long, n long, source_size long, target double, whole long, extra long"
    quotas = write_table(hist.groupBy("source").applyInPandas(plan, kind).withColumn("buckets", F.ceil(F.col("n") / bucket_rows).cast("long")), "mix-quotas")
    drop_table(hist)
    q = quotas.select(F.coalesce("source", F.lit("")).alias("q_source"), F.col("source").isNull().alias("q_null"), F.col("size").alias("q_size"), "n", "source_size", "target", "whole", "extra", "buckets")
    keyed = rows.withColumn("q_source", F.coalesce("source", F.lit(""))).withColumn("q_null", F.col("source").isNull()).withColumn("q_size", F.col("size")).drop("source")
    joined = keyed.join(q, ["q_source", "q_null", "q_size"]).withColumn("bucket", F.pmod("h", "buckets"))
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    key = ["q_source", "q_null", "q_size"]
    out = ["row", "size", "source_size", "target"]
    whole = joined.where(~some).select(*out, (F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("copies"))
    # the numbers before each bucket, for lengths of which some are taken
    counts = rows.select(F.coalesce("source", F.lit("")).alias("q_source"), F.col("source").isNull().alias("q_null"), F.col("size").alias("q_size"), "h").join(q, key).where(some).groupBy(*key, F.pmod("h", "buckets").alias("bucket")).agg(F.count("*").alias("here"))
    before = counts.select(*key, "bucket", F.coalesce(F.sum("here").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = joined.where(some).withColumn("nth", F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("h"))).join(before, [*key, "bucket"])
    part = ranked.select(*out, (F.col("whole") + (F.col("before") + F.col("nth") <= F.col("extra")).cast("long")).alias("copies"))
    return whole.union(part)


def mixed_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every row; see ``mix``."""
    return mix(docs, ["doc_id"], **options).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each taken document as often as it is taken, with the columns of ``docs``."""
    taken = mix(docs, docs.columns, keep_rows=False, **options).where("copies > 0 and size > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
