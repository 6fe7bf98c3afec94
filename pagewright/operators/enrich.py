"""External calls as an operator: store first, then a pluggable translator, results as rows.

No service is called by default. ``Translator`` is any object with ``translate(text, session)``;
it is shipped to executors and called once for each unit that the store doesn't hold.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import predicates as P

#: Seconds between tries of services without and with keys.
FREE_DELAYS, KEYED_DELAYS = (0.5, 1.2), ()
MESSAGE = 500


class CallError(Exception):
    """A failed call: a code and, where the service answered, its status."""

    def __init__(self, code: str, status: int = 0, message: str = ""):
        super().__init__(message or code)
        self.code, self.status = code, status


class Translator(Protocol):
    provider: str
    model: str

    def translate(self, text: str, session: dict) -> str: ...


@dataclass
class Offline:
    """A deterministic stand-in: the text itself, marked."""

    provider: str = "offline"
    model: str = "echo"

    def translate(self, text: str, session: dict) -> str:
        return f"[{self.model}] {text}"


#: Known providers by id.
PROVIDERS: dict[str, Callable[[], Translator]] = {"offline": Offline}


def provider(name: str | None) -> Translator | None:
    """Unknown or missing names have none."""
    make = PROVIDERS.get(name or "")
    return make() if make else None


def choose_model(available: list[str], preferred: list[str]) -> str | None:
    """The first preferred model on offer."""
    return min((m for m in available if m in preferred), key=preferred.index, default=None)


def with_retries(call: Callable[[], str], delays: tuple[float, ...] = FREE_DELAYS, sleep: Callable[[float], None] = time.sleep) -> str:
    """Tries again after each delay on a network error or a passing status, else raises."""
    for k in range(len(delays) + 1):
        try:
            return call()
        except CallError as e:
            passing = not e.status or e.status in (408, 425, 429) or e.status >= 500
            if k == len(delays) or not passing or e.code == "cancelled":
                raise
            sleep(delays[k])
    raise AssertionError


class TokenCache:
    """One token for each worker, fetched again when old or refused."""

    def __init__(self, fetch: Callable[[], str], seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.fetch, self.seconds, self.clock, self.token, self.since = fetch, seconds, clock, None, 0.0

    def get(self, refresh: bool = False) -> str:
        if refresh or self.token is None or self.clock() - self.since >= self.seconds:
            self.token, self.since = self.fetch(), self.clock()
        return self.token

    def use(self, call: Callable[[str], str]) -> str:
        try:
            return call(self.get())
        except CallError as e:
            if e.status not in (401, 403):
                raise
            return call(self.get(refresh=True))


def units_of(text: Column, units: Column) -> Column:
    """units with id and text, ids by position where missing; the whole text where there are none."""
    named = F.transform(units, lambda u, i: F.struct(F.coalesce(F.when(u["id"] != "", u["id"]), F.concat(F.lit("unit-"), i)).alias("id"), F.trim(F.coalesce(u["source_text"], F.lit(""))).alias("source_text"), F.when(u["break_after"] == "paragraph", "paragraph").otherwise("none").alias("break_after")))
    kept = F.filter(named, lambda u: u["source_text"] != "")
    whole = F.array(F.struct(F.lit("unit-0").alias("id"), F.trim(F.coalesce(text, F.lit(""))).alias("source_text"), F.lit("none").alias("break_after")))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(whole)


def composed(units: Column) -> Column:
    """Texts of units in order, a blank line after a paragraph; empty ones add nothing.

    ``units`` is array<struct<translated_text, break_after>>; the break looked at is that of the
    unit just before.
    """
    trimmed = F.transform(units, lambda u: F.trim(F.coalesce(u["translated_text"], F.lit(""))))

    def add(acc: Column, i: Column) -> Column:
        value = F.get(trimmed, i)
        gap = F.when((i > 0) & (F.get(units, i - 1)["break_after"] == "paragraph"), "\n\n").otherwise("")
        return F.when(value == "", acc).when(acc == "", value).otherwise(F.concat(acc, gap, value))

    return F.when(F.size(units) == 0, "").otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(units) - 1, F.lit(0))), F.lit(""), add))


def envelope(text: Column, units: Column) -> Column:
    """the stored form of a selection's result."""
    return F.to_json(F.struct(F.lit("selection-translation").alias("type"), F.lit(1).alias("version"), text.alias("translatedText"), units.alias("translatedUnits")))


def opened_envelope(c: Column, expected_ids: Column) -> Column:
    """struct<translatedText, translatedUnits>, null unless type, version, text and unit ids agree."""
    e = F.from_json(c, "type string, version int, translatedText string, translatedUnits array<struct<id: string, translatedText: string, breakAfter: string>>")
    ids = F.transform(e["translatedUnits"], lambda u: u["id"])
    return F.when((e["type"] == "selection-translation") & (e["version"] == 1) & (F.trim(e["translatedText"]) != "") & (ids == expected_ids), F.struct(e["translatedText"], e["translatedUnits"]))


#: Fixed value: a letter that a translated text must have.
CJK = "[㐀-鿿]"
TAG, BREAK = r"<[^>]+>", r"(?i)<\s*br\s*/?>"


def text_error(kind: Column, text: Column) -> Column:
    """Code of the first rule that a translated title, abstract or unit breaks, else null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    breaks = F.regexp_count(t, F.lit(BREAK))
    parts = F.transform(F.split(t, BREAK), F.trim)
    left, right = F.get(parts, 0), F.get(parts, 1)
    other_tag = F.regexp_replace(t, BREAK, "").rlike(TAG)
    selection = P.selection_kind(kind)
    return (
        F.when((t == "") | ~t.rlike(CJK), F.when(selection, "invalid-selection-unit").otherwise("invalid-row"))
        .when(selection & ((breaks > 0) | t.rlike(TAG) | t.rlike(r"\n\s*\n")), "invalid-selection-html")
        .when(~selection & (kind != "title") & ((breaks > 0) | t.rlike(TAG)), "invalid-abstract-html")
        .when((kind == "title") & other_tag, "invalid-title-html")
        .when((kind == "title") & (breaks > 1), "multiple-title-breaks")
        .when((kind == "title") & (breaks == 1) & ((left == "") | (right == "") | P.splits_token(left, right)), "invalid-title-break")
    )


def response_errors(expected: DataFrame, rows: DataFrame, *, keys: list[str]) -> DataFrame:
    """For each group 'row-count' or 'invalid-row' (unknown or repeated id), else null.

    ``expected`` and ``rows`` have the keys and id.
    """
    e = expected.groupBy(*keys, "id").agg(F.count("*").alias("wanted"))
    r = rows.groupBy(*keys, "id").agg(F.count("*").alias("got"))
    both = e.join(r, [*keys, "id"], "full_outer").na.fill(0, ["wanted", "got"])
    return both.groupBy(*keys).agg(F.when(F.sum("got") != F.count_if(F.col("wanted") > 0), "row-count").when(F.max(((F.col("wanted") == 0) | (F.col("got") > 1)).cast("int")) == 1, "invalid-row").alias("error_code"))


def result_row(segment_id: Column, status: Column, text: Column, code: Column, status_code: Column, message: Column, **more: Column) -> list[Column]:
    """X11: a result's columns; without a code the service's status is one; messages are cut to 500."""
    return [
        segment_id.alias("segment_id"), status.alias("status"), F.coalesce(text, F.lit("")).alias("translated_text"),
        F.coalesce(code, F.when(status_code > 0, F.concat(F.lit("http-"), status_code.cast("string"))), F.lit("")).alias("error_code"), F.substring(F.coalesce(message, F.lit("")), 1, MESSAGE).alias("error_message"), *[c.alias(n) for n, c in more.items()],
    ]


def stopped_queue(results: DataFrame, *, keys: list[str], order: str) -> DataFrame:
    """After the first 401 or 403 of a queue all later calls are failed as 'auth-stopped'."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    stop = F.coalesce(F.max(F.col("http_status").isin(401, 403).cast("int")).over(w), F.lit(0)) == 1
    return results.withColumn("stop", stop).withColumns({"status": F.when(F.col("stop"), "failed").otherwise(F.col("status")), "error_code": F.when(F.col("stop"), "auth-stopped").otherwise(F.col("error_code"))}).drop("stop")


def enrich(segments: DataFrame, cached: DataFrame, translator: Translator | None, *, source_language: str = "en", bypass_cache: bool = False, needs_key: bool = False, key: str = "", delays: tuple[float, ...] = FREE_DELAYS) -> DataFrame:
    """One result for each segment: skipped, cached, translated or failed.

    ``segments`` has segment_id, kind, source_language, confidence, source_text, units;
    ``cached`` has segment_id and translated_text. Ineligible segments are skipped; what the
    store holds is never sent; the rest is sent unit by unit inside mapInPandas.
    """
    usable = P.eligible(F.col("kind"), F.col("source_language"), F.lit(source_language), F.col("confidence"))
    marked = segments.withColumn("eligible", usable)
    stored = cached.select("segment_id", F.col("translated_text").alias("stored")).where(F.trim("stored") != "")
    if bypass_cache:
        stored = stored.where("false")
    joined = marked.join(stored, "segment_id", "left")
    nothing = F.lit(None).cast("string")
    skipped = joined.where("not eligible").select(*result_row(F.col("segment_id"), F.lit("skipped"), nothing, nothing, F.lit(0), nothing))
    hits = joined.where("eligible and stored is not null").select(*result_row(F.col("segment_id"), F.lit("cached"), F.col("stored"), nothing, F.lit(0), nothing))
    misses = joined.where("eligible and stored is null")
    if translator is None or (needs_key and not key):
        status, code = ("skipped", "no-provider") if translator is None else ("failed", "missing-key")
        called = misses.select(*result_row(F.col("segment_id"), F.lit(status), nothing, F.lit(code), F.lit(0), F.lit(code)))
        return skipped.union(hits).union(called)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for seg, units in zip(batch["segment_id"], batch["units"], strict=True):
                try:
                    texts = [(with_retries(lambda u=u: translator.translate(u["source_text"], {}), delays) or "").strip() for u in units]
                    code, status, message = (None, 0, None) if all(texts) and texts else ("empty-selection-unit" if len(units) > 1 else "empty-translation", 0, "")
                except CallError as e:
                    texts, code, status, message = [], e.code, e.status, str(e)
                rows.append((seg, texts if code is None else [], [u["break_after"] for u in units], code, status, message))
            yield pd.DataFrame(rows, columns=["segment_id", "texts", "breaks", "code", "http_status", "message"])

    kind = dict(segments.dtypes)["segment_id"]
    sent = misses.select("segment_id", units_of(F.col("source_text"), F.col("units")).alias("units")).mapInPandas(call, f"segment_id {kind}, texts array<string>, breaks array<string>, code string, http_status int, message string")
    text = composed(F.zip_with("texts", "breaks", lambda t, b: F.struct(t.alias("translated_text"), b.alias("break_after"))))
    called = sent.select(*result_row(F.col("segment_id"), F.when(F.col("code").isNull(), "translated").otherwise("failed"), F.when(F.col("code").isNull(), text), F.col("code"), F.col("http_status"), F.col("message")))
    return skipped.union(hits).union(called)


def diagnostics(results: DataFrame) -> DataFrame:
    """Numbers by status."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.agg(F.count("*").alias("total"), n("cached"), n("translated"), n("skipped"), n("failed"))


def call_error(code: Column, message: Column, status: Column, request_id: Column) -> Column:
    """Struct of a service's error."""
    return F.struct(F.coalesce(code, F.concat(F.lit("http-"), status.cast("string"))).alias("code"), F.coalesce(message, F.lit("")).alias("message"), status.alias("status"), request_id.alias("request_id"))


def single_segment_error(count: Column, text: Column) -> Column:
    """X10: 'single-segment-only', 'empty-source-text' or null."""
    return F.when(count != 1, "single-segment-only").when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty-source-text")
