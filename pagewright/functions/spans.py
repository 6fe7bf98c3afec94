"""Cutting, anchoring and apportioning text."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from pagewright.functions import text as T
from pagewright.functions.binding import let

#: Marks after which a text may be cut.
CUT_AFTER = ("。", "！", "？", "；", ". ", "! ", "? ", "; ", "\n")


#: Places after which a text may be cut, and spaces, the second choice.
SENTENCE_END, SPACE_AFTER = re.compile("|".join(re.escape(m) for m in CUT_AFTER)), re.compile(" ")


def cut_text(text: str, limit: int) -> list[str]:
    """parts of at most ``limit`` UTF-16 units whose concatenation is the text, cut at sentence ends.

    All places are found once; a part then ends at its last sentence end, or, where that lies in
    its first half, at its last space in the second half, or else at that sentence end or full.
    A character of two units is split only under a limit of one.
    """
    if limit < 1 or len(text) <= limit and (text.isascii() or len(text.encode("utf-16-le")) <= 2 * limit):
        return [text]
    astral = [i for i, c in enumerate(text) if c > "\uffff"] if not text.isascii() else []
    units = lambda i: i + bisect_left(astral, i)  # noqa: E731  UTF-16 units before a character

    ends, spaces = ([m.span()[::-1] for m in pattern.finditer(text)] for pattern in (SENTENCE_END, SPACE_AFTER))
    parts, start = [], 0
    while units(len(text)) - units(start) > limit:
        full = bisect_right(range(len(text) + 1), units(start) + limit, key=units) - 1
        if full == start:  # a character of two units under a limit of one goes by halves
            pair = text[start].encode("utf-16-le")
            parts += [half.decode("utf-16-le", "surrogatepass") for half in (pair[:2], pair[2:])]
            start += 1
            continue

        def last(places: list[tuple[int, int]], start=start, full=full) -> int:
            """The last mark that lies in the part as a whole."""
            end, begin = places[i - 1] if (i := bisect_left(places, (full + 1, 0))) else (0, -1)
            return end if begin >= start else 0

        sentence, space, half = last(ends), last(spaces), units(start) + limit // 2
        if units(sentence) < half and space and units(space) > half:
            cut = space
        else:
            cut = sentence or full
        parts.append(text[start:cut])
        start = cut
    return [*parts, text[start:]] if start < len(text) else parts


def chunks(c: Column, limit: int) -> Column:
    """array of the parts; null or blank text has none."""

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_text(t, limit) if t and t.strip() else [])

    return cut(c)


def sent_and_merged(parts: Column, send=lambda c: c) -> Column:
    """each part trimmed, sent and the answers joined without anything between."""
    return F.array_join(F.transform(parts, lambda p: send(F.regexp_replace(p, f"^{T.SPACE}+|{T.SPACE}+$", ""))), "")


def graphemes(c: Column) -> Column:
    """what readers see as characters."""
    return F.regexp_extract_all(c, F.lit(r"\X"), F.lit(0))


def _anchor(text: Column, start: Column, end: Column) -> Column:
    """A range grown to word edges, as struct<text, start, end>; white space is single spaces."""
    start, end = start.cast("int"), end.cast("int")
    last_space = lambda head: F.char_length(head) - F.locate(" ", F.reverse(head)) + 1
    left = let(F.substring(text, F.lit(1), start + 1), lambda head: F.when(F.instr(head, F.lit(" ")) == 0, F.lit(0)).otherwise(last_space(head)))
    right = let(F.call_function("locate", F.lit(" "), text, F.greatest(end, F.lit(1))), lambda at: F.when(at == 0, F.char_length(text)).otherwise(at - 1))
    return let(F.struct(left.alias("a"), right.alias("b")), lambda r: F.struct(F.substring(text, r["a"] + 1, r["b"] - r["a"]).alias("text"), r["a"].cast("long").alias("start"), r["b"].cast("long").alias("end")))


def anchors(target: Column, kind: str) -> Column:
    """array<struct<text, start, end>> of up to three parts of a normalised text.

    Texts up to 48 (title) or 96 characters are one anchor; longer ones have windows at start,
    middle and end, grown to word edges, of 12 characters at least and different.
    """
    whole_up_to = 48 if kind == "title" else 96

    def of(v: Column) -> Column:
        text, n = v["text"], v["n"]
        half = F.floor(n / 2)
        width = F.least(F.lit(44), F.greatest(F.lit(24), half)) if kind == "title" else F.least(F.lit(48), F.greatest(F.lit(32), F.floor(n / 4)))

        def windows(w: Column) -> Column:
            first, last = _anchor(text, F.lit(0), w), _anchor(text, n - w, n)
            middle = _anchor(text, half - F.floor(w / 2), half + F.ceil(w / 2))
            three = F.array(first, middle, last)
            return F.when(n <= 96, F.array(first, last)).otherwise(three) if kind == "title" else three

        def kept(found: Column) -> Column:
            return let(F.filter(found, lambda a: F.char_length(a["text"]) >= 12), lambda long: let(F.transform(long, lambda a: a["text"]), lambda seen: F.filter(long, lambda a, i: F.array_position(seen, a["text"]) == i + 1)))

        whole = F.array(F.struct(text.alias("text"), F.lit(0).cast("long").alias("start"), n.cast("long").alias("end")))
        return F.when(n == 0, F.slice(whole, F.lit(1), F.lit(0))).when(n <= whole_up_to, whole).otherwise(let(let(width, windows), kept))

    return let(F.struct(target.alias("text"), F.char_length(target).alias("n")), of)


#: Least coverage by kind, and that of high confidence.
LEAST_COVERAGE = {"title": 0.72, "abstract": 0.60}
HIGH_COVERAGE = 0.85


def match_anchors(text: Column, found: Column, target_length: Column, kind: str) -> Column:
    """Anchors searched in ``text``, those of an abstract each after the one before.

    Returns struct<matched, anchor_count, coverage, confidence, first_start, last_end (in the
    text), target_start, target_end (in the target)> or null where too few anchors or too little
    of the target match.
    """

    def step(acc: Column, a: Column) -> Column:
        def moved(at: Column) -> Column:
            hit, end = at > 0, (at - 1 + F.char_length(a["text"])).cast("long")
            to = F.when(hit, end).otherwise(acc["next"]) if kind == "abstract" else F.lit(0).cast("long")
            return F.struct(
                to.alias("next"), (acc["matched"] + hit.cast("long")).alias("matched"), (acc["covered"] + F.when(hit, a["end"] - a["start"]).otherwise(0)).alias("covered"),
                F.when(hit, F.least(acc["low"], a["start"])).otherwise(acc["low"]).alias("low"), F.when(hit, F.greatest(acc["high"], a["end"])).otherwise(acc["high"]).alias("high"),
                F.when(hit & (acc["matched"] == 0), (at - 1).cast("long")).otherwise(acc["first_start"]).alias("first_start"), F.when(hit, end).otherwise(acc["last_end"]).alias("last_end"),
            )

        return let(F.call_function("locate", a["text"], text, (acc["next"] + 1).cast("int")), moved)

    big = F.lit(2**40)
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("next"), zero.alias("matched"), zero.alias("covered"), big.alias("low"), zero.alias("high"), zero.alias("first_start"), zero.alias("last_end"))

    def done(acc: Column) -> Column:
        n = F.greatest(F.lit(1), target_length)
        direct = F.least(F.lit(1.0), acc["covered"] / n)
        span = F.when(acc["matched"] >= 2, (acc["high"] - acc["low"]) / n).otherwise(F.lit(0.0))
        coverage = F.least(F.lit(1.0), F.greatest(direct, span))
        count = F.size(found).cast("long")
        fine = (count > 0) & (acc["matched"] >= F.least(F.lit(2), count)) & (coverage >= LEAST_COVERAGE[kind])
        confidence = F.when((acc["matched"] == count) & (coverage >= HIGH_COVERAGE), "high").otherwise("medium")
        return F.when(fine, F.struct(acc["matched"].alias("matched"), count.alias("anchor_count"), coverage.alias("coverage"), confidence.alias("confidence"), acc["first_start"].alias("first_start"), acc["last_end"].alias("last_end"), acc["low"].alias("target_start"), acc["high"].alias("target_end")))

    return F.aggregate(found, start, step, done)


WORDS = re.compile(r"[^\W_]+")


def common_words(expected: list[str], actual: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, w in enumerate(expected):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(expected)) - 1
    row = full
    for w in actual:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(expected) - row.bit_count()


def ordered_coverage(expected: Column, actual: Column) -> Column:
    """share of the first text's words that the second has in the same order."""

    @F.pandas_udf(DoubleType())
    def covered(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            want, got = WORDS.findall(x or ""), WORDS.findall(y or "")
            out.append(common_words(want, got) / len(want) if want and got else 0.0)
        return pd.Series(out)

    return covered(expected, actual)


def split_by_weight(text: Column, weights: Column) -> Column:
    """Characters dealt to parts in proportion to ``weights``, cut at rounded running sums.

    No more characters than parts: all go to the first one.
    """
    w = F.transform(weights, lambda x: F.greatest(F.lit(1.0), x.cast("double")))
    n, parts, total = F.char_length(text), F.size(weights), F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    running = F.transform(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), lambda i: F.aggregate(F.slice(w, F.lit(1), i), F.lit(0.0), lambda a, x: a + x))
    cut = F.transform(running, lambda s: F.least(n, F.floor(n * s / total + 0.5).cast("int")))
    piece = F.transform(cut, lambda e, i: F.substring(text, F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1)) + 1, F.when(i == parts - 1, n).otherwise(e) - F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1))))
    few = F.transform(weights, lambda x, i: F.when(i == 0, text).otherwise(""))
    return F.when(parts == 0, F.array().cast("array<string>")).when(n <= parts, few).otherwise(piece)


def break_priority(left: str, right: str, blank: bool) -> int:
    """How good a place between two characters is for a cut, 0 best."""
    if blank:
        return 0
    if left in ".!?。！？" and left:
        return 1
    if left in ";；:：" and left:
        return 2
    if left in ",，、" and left:
        return 3
    return 4 if left.isspace() or right.isspace() else 5


def break_index(chars: list[str], goal: int, low: int, high: int) -> int:
    """The best place for a cut near ``goal``, between ``low`` and ``high``; ``goal`` where none is near.

    Places up to 8 % of the text away count, 6 at least; better ones by ``break_priority``, then
    nearer ones, then earlier ones.
    """
    reach = max(6, int(len(chars) * 0.08 + 0.5))
    places = range(max(low, goal - reach), min(len(chars) - 1, high, goal + reach) + 1)
    blank = lambda k: k > 1 and chars[k - 2] == "\n" == chars[k - 1]
    return min(places, key=lambda k: (break_priority(chars[k - 1], chars[k], blank(k)), abs(k - goal), k), default=goal)


def allocate(chars: list[str], weights: list[float]) -> list[str]:
    """Y2: characters dealt to parts by weight, cuts moved to the best place near; one each while they last.

    The running sums of the weights are the goals of the cuts; every later part keeps one
    character.
    """
    if not weights or not chars:
        return [""] * len(weights)
    total, cuts = max(1.0, sum(weights)), [0]
    for left, share in zip(range(len(weights) - 1, 0, -1), accumulate(weights), strict=False):
        low, high = cuts[-1] + 1, len(chars) - left
        goal = max(low, min(high, int(len(chars) * share / total + 0.5)))
        cuts.append(min(low, len(chars)) if high < low else break_index(chars, goal, low, high))
    return ["".join(chars[a:b]) for a, b in pairwise([*cuts, len(chars)])]


def allocated(characters: Column, weights: Column) -> Column:
    """Y2 for arrays of graphemes and of weights."""

    @F.pandas_udf(ArrayType(StringType()))
    def dealt(chars: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([allocate(list(c), list(w)) for c, w in zip(chars, parts, strict=True)])

    return dealt(characters, weights)
