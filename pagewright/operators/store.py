"""The keyed result store: point and range reads, upserts, invalidation, purge, sweep, merge.

A store is two DataFrames, records and attachment states. Every change makes new DataFrames
(Parquet has no MERGE); a caller writes them as the next snapshot. Changes are folded from a
log: what a later event undid is left out by comparing positions in the log, so each rule is an
aggregation on the attachment's key and a join, not a loop over events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

KEY = ["library_id", "attachment_key"]
#: Types of the columns of the two tables.
STATES = "library_id bigint, attachment_key string, attachment_item_id bigint, parent_item_id bigint, file_fingerprint string, is_trashed int, first_seen_at bigint, last_seen_at bigint, last_checked_at bigint"
RECORDS = (
    "record_id string, library_id bigint, attachment_key string, attachment_item_id bigint, parent_item_id bigint, file_fingerprint string, segment_kind string, segment_id string, source_text string, source_hash string, source_units_json string, "
    "position_json string, position_signature string, source_language string, target_language string, prompt_version string, translated_text string, translated_units_json string, provider string, model string, created_at bigint, updated_at bigint, last_used_at bigint"
)
VERSION = 2


def file_fingerprint(attachment_hash: Column, size: Column, modified: Column) -> Column:
    """``hash:<hash>``, else ``stat:<size>:<time>``, else null."""
    h = F.lower(F.trim(attachment_hash.cast("string")))
    usable = lambda c: c.isNotNull() & (c >= 0) & (c < float("inf"))
    return F.coalesce(F.when(h != "", F.concat(F.lit("hash:"), h)), F.when(usable(size) & usable(modified), F.concat_ws(":", F.lit("stat"), size.cast("string"), modified.cast("string"))))


def needs_rebuild(version: int | None) -> bool:
    """Whether a stored snapshot has to be dropped."""
    return version != VERSION


def normalized_records(rows: DataFrame) -> DataFrame:
    """typed columns with defaults; missing ones are added, unreadable numbers are 0 or null."""
    out = []
    for field in RECORDS.split(", "):
        name, kind = field.split()
        c = F.col(name).try_cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        out.append((c if name in ("attachment_item_id", "parent_item_id") else F.coalesce(c, F.lit("" if kind == "string" else 0).cast(kind))).alias(name))
    return rows.select(*out)


def get(records: DataFrame, wanted: DataFrame, *, now: Column) -> DataFrame:
    """Stored rows for ``wanted`` identities: equal record_id and equal in all identity fields, used now."""
    fields = ["library_id", "attachment_key", "file_fingerprint", "segment_kind", "position_signature", "source_hash", "source_language", "target_language", "prompt_version"]
    w = wanted.select(F.col("record_id").alias("w_id"), *[F.col(f).alias(f"w_{f}") for f in fields])
    same = F.col("record_id") == F.col("w_id")
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"w_{f}"))
    return records.join(w, same, "left_semi").withColumn("last_used_at", now)


def list_for_attachment(records: DataFrame, attachments: DataFrame, *, target_language: str, prompt_version: str | None = None, kinds: tuple[str, ...] = ("custom", "unclassified")) -> DataFrame:
    """Selection records of current attachments, malformed positions left out, in order of creation."""
    out = records.where(F.col("segment_kind").isin(*kinds) & (F.col("target_language") == target_language)).join(attachments.select(*KEY, "file_fingerprint"), [*KEY, "file_fingerprint"], "left_semi")
    out = out.where(F.try_parse_json("position_json").isNotNull())
    if prompt_version is not None:
        out = out.where(F.col("prompt_version") == prompt_version)
    return out.orderBy("created_at", "record_id")


def put(records: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows (with updated_at) replace stored ones of the same record_id; the first created_at stays.

    Blank results are not stored. A new title or abstract removes the other records of its
    attachment, fingerprint, kind and languages.
    """
    fresh = new.where(F.trim("translated_text") != "")
    every = records.withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True)), allowMissingColumns=True)
    last = Window.partitionBy("record_id").orderBy(F.desc("is_new"), F.desc("updated_at"))
    every = every.withColumn("created_at", F.min("created_at").over(Window.partitionBy("record_id"))).withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")
    group = [*KEY, "file_fingerprint", "segment_kind", "source_language", "target_language"]
    front = F.col("segment_kind").isin("title", "abstract")
    newest = F.first(F.struct("is_new", "updated_at", "record_id")).over(Window.partitionBy(*group).orderBy(F.desc("is_new"), F.desc("updated_at"), F.desc("record_id")))
    every = every.withColumn("newest", newest)
    return every.where(~front | ~F.col("newest.is_new") | (F.col("record_id") == F.col("newest.record_id"))).drop("newest", "is_new")


def remove(records: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Records without those named in ``gone``."""
    return records.join(gone.select(*on).distinct(), on, "left_anti")


def purge_by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose item and whose parent are not among ``ids`` (item_id); null ids stay."""
    gone = ids.select(T.positive_id(F.col("item_id")).cast("long").alias("gone_id")).where("gone_id is not null").distinct()
    kept = rows.join(gone, F.col("attachment_item_id") == F.col("gone_id"), "left_anti")
    return kept.join(gone, F.col("parent_item_id") == F.col("gone_id"), "left_anti")


def set_trashed(states: DataFrame, ids: DataFrame, trashed: bool) -> DataFrame:
    """States of the items or parents in ``ids`` flagged; reads don't look at the flag."""
    mine = ids.select(T.positive_id(F.col("item_id")).cast("long").alias("item_id")).where("item_id is not null").distinct()
    by_item = states.join(mine, F.col("attachment_item_id") == F.col("item_id"), "left").withColumn("hit", F.col("item_id").isNotNull()).drop("item_id")
    by_parent = by_item.join(mine, F.col("parent_item_id") == F.col("item_id"), "left").withColumn("hit", F.col("hit") | F.col("item_id").isNotNull()).drop("item_id")
    return by_parent.withColumn("is_trashed", F.when(F.col("hit"), int(trashed)).otherwise(F.col("is_trashed"))).drop("hit")


def sweep_orphans(records: DataFrame, states: DataFrame) -> DataFrame:
    """Records whose attachment has a state."""
    return records.join(states.select(*KEY).distinct(), KEY, "left_semi")


def collect_garbage(records: DataFrame, states: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States whose item is known to be missing go, and then orphaned records.

    ``items`` has item_id and found (null where the lookup failed; such states stay), as do
    states without item.
    """
    missing = items.where(F.col("found") == False).select(F.col("item_id").alias("missing_id")).distinct()  # noqa: E712
    kept = states.join(missing, F.col("attachment_item_id") == F.col("missing_id"), "left_anti")
    return sweep_orphans(records, kept), kept


def change_kind(event: Column, kind: Column, deleted: Column) -> Column:
    """What a change event asks for: 'delete', 'trash', 'untrash' or null.

    ``deleted`` is the new value of the deleted flag that a modification carries.
    """
    e, k = F.lower(F.coalesce(event, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(e == "delete", "delete")
        .when((e == "trash") | ((k == "trash") & e.isin("add", "modify")), "trash")
        .when((e == "untrash") | ((k == "trash") & (e == "remove")), "untrash")
        .when((e == "modify") & deleted, "trash")
        .when((e == "modify") & ~deleted, "untrash")
    )


def partial_states(log: DataFrame, *, key: list[str]) -> DataFrame:
    """What a stretch of the log does to each attachment that it names, to be merged with what was before.

    ``log`` has the key, seq (total order), change ('open', 'put', 'trash', 'untrash',
    'delete') and fingerprint (for 'open'; unknown ones change nothing). Returns key, cleared
    (whether a delete stands in it) and, of the changes after the last delete: fingerprint,
    opened, opens, flag, flag_seq, seen. Sums are made before rows move; the one join brings
    back the deletes, which are few.
    """
    gone = log.where("change = 'delete'").groupBy(*key).agg(F.max("seq").alias("gone"))
    marked = log.join(gone, key, "left")
    live = (F.col("gone").isNull() | (F.col("seq") > F.col("gone"))) & ((F.col("change") != "open") | F.col("fingerprint").isNotNull())
    of = lambda c: F.when(live & c, F.col("seq"))
    is_open, is_flag = F.col("change") == "open", F.col("change").isin("trash", "untrash")
    return marked.groupBy(*key).agg(
        F.bool_or(F.col("gone").isNotNull()).alias("cleared"), F.max_by("fingerprint", of(is_open)).alias("fingerprint"), F.min(of(is_open)).alias("opened"), F.count(of(is_open)).alias("opens"),
        F.max_by("change", of(is_flag)).alias("flag"), F.max(of(is_flag)).alias("flag_seq"), F.max(of(F.col("change") != "put")).alias("seen"),
    )


STATE = ["fingerprint", "is_trashed", "first_seen", "last_seen", "opens"]


def merged_states(states: DataFrame, partial: DataFrame, *, key: list[str]) -> DataFrame:
    """The states of the attachments in ``partial`` after it, null where there is none.

    ``states`` are those before; the changes in ``partial`` come after all that made them.
    """
    before = states.select(*key, F.struct(*STATE).alias("s"))
    both = partial.join(before, key, "left").withColumn("s", F.when(~F.col("cleared"), F.col("s")))
    had = F.col("s").isNotNull()
    flagged = F.col("flag").isNotNull() & (had | (F.col("flag_seq") >= F.col("opened")))
    now = F.struct(
        F.coalesce("fingerprint", "s.fingerprint").alias("fingerprint"), F.when(flagged, (F.col("flag") == "trash").cast("int")).otherwise(F.coalesce("s.is_trashed", F.lit(0))).alias("is_trashed"),
        F.coalesce("s.first_seen", "opened").alias("first_seen"), F.coalesce("seen", "s.last_seen").alias("last_seen"), (F.coalesce("s.opens", F.lit(0)) + F.col("opens")).alias("opens"),
    )
    return both.select(*key, F.when(had | F.col("opened").isNotNull(), now).alias("state"))


def fold_log(log: DataFrame, *, key: list[str]) -> DataFrame:
    """The state of each attachment after its whole log, for those not deleted.

    A delete clears all before it. Returns key, fingerprint, is_trashed, first_seen,
    last_seen, opens. See ``partial_states`` for the log.
    """
    none = log.where("false").select(*key, F.lit("").alias("fingerprint"), F.lit(0).alias("is_trashed"), F.col("seq").alias("first_seen"), F.col("seq").alias("last_seen"), F.lit(0).cast("long").alias("opens"))
    return merged_states(none, partial_states(log, key=key), key=key).where("state is not null").select(*key, "state.*")


def fold_records(log: DataFrame, *, key: list[str], record: str) -> DataFrame:
    """Records that a log leaves: put while open, not cleared by a later delete or change of fingerprint.

    Returns key, record, fingerprint, created (seq), updated (seq).
    """
    w = Window.partitionBy(*key).orderBy("seq")
    known = log.where("change <> 'open' or fingerprint is not null")
    epoch = F.sum((F.col("change") == "delete").cast("long")).over(w)
    known = known.withColumn("epoch", epoch)
    opens = known.where("change = 'open'").withColumn("before", F.lag("fingerprint").over(Window.partitionBy(*key, "epoch").orderBy("seq")))
    resets = opens.where("before is null or before <> fingerprint").select(*key, "epoch", "seq", "fingerprint", F.lit("reset").alias("change"), F.lit(None).cast(dict(log.dtypes)[record]).alias(record))
    puts = known.where("change = 'put'").select(*key, "epoch", "seq", F.lit(None).cast("string").alias("fingerprint"), "change", record)
    both = puts.unionByName(resets).withColumn("current", F.last("fingerprint", ignorenulls=True).over(Window.partitionBy(*key, "epoch").orderBy("seq"))).withColumn("since", F.max(F.when(F.col("change") == "reset", F.col("seq"))).over(Window.partitionBy(*key, "epoch").orderBy("seq")))
    last_reset = resets.groupBy(*key).agg(F.max_by("seq", F.struct("epoch", "seq")).alias("last_since"), F.max("epoch").alias("last_epoch"))
    deletes = log.groupBy(*key).agg(F.count_if(F.col("change") == "delete").alias("deletes"))
    live = both.where("change = 'put' and since is not null").join(last_reset, key).join(deletes, key).where("since = last_since and epoch = last_epoch and epoch = deletes")
    return live.groupBy(*key, record).agg(F.first("current").alias("fingerprint"), F.min("seq").alias("created"), F.max("seq").alias("updated"))


def merge_last_good(previous: DataFrame, new: DataFrame, *, keys: list[str]) -> DataFrame:
    """Results by key; a failed or skipped one never replaces a cached or translated one."""
    p = previous.select(*keys, F.struct(*[c for c in previous.columns if c not in keys]).alias("old"))
    n = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("new"))
    good = lambda c: F.coalesce(c["status"].isin("cached", "translated"), F.lit(False))
    pick = F.when(F.col("new").isNull() | (~good(F.col("new")) & good(F.col("old"))), F.col("old")).otherwise(F.col("new"))
    return p.join(n, keys, "full_outer").select(*keys, pick.alias("r")).select(*keys, "r.*")


def merge_targets(previous: DataFrame, new: DataFrame, *, keys: list[str]) -> DataFrame:
    """Targets by key, new ones first."""
    others = [c for c in new.columns if c not in keys]
    p = previous.select(*keys, F.struct(*others).alias("old"))
    n = new.select(*keys, F.struct(*others).alias("new"))
    return p.join(n, keys, "full_outer").select(*keys, F.coalesce("new", "old").alias("t")).select(*keys, "t.*")


def preview(segments: DataFrame, results: DataFrame, *, keys: list[str], order: str) -> DataFrame:
    """Successful texts of each group in order, blank lines between."""
    good = results.where(F.col("status").isin("cached", "translated") & (F.trim("translated_text") != "")).select("segment_id", T.preview(F.col("translated_text")).alias("shown"))
    joined = segments.join(good, "segment_id")
    return joined.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "shown"))), lambda x: x["shown"]), "\n\n").alias("preview"), F.count("*").alias("parts"))


def page_index(records: DataFrame) -> DataFrame:
    """Page and record of each page that a record's positions (array ``pages``) touch."""
    return records.select(F.explode(F.array_distinct("pages")).alias("page"), "record_id", "sequence")


def render_window(index: DataFrame, current: int, around: int = 1) -> DataFrame:
    """Rows of the pages around the current one, in order of sequence."""
    return index.where(F.col("page").between(current - around, current + around)).orderBy("page", "sequence")


def hydrate(records: DataFrame, segments: DataFrame) -> DataFrame:
    """Stored records whose rebuilt segment agrees in signature, text, units, language and fingerprint."""
    s = segments.select(*[F.col(c).alias(f"s_{c}") for c in segments.columns])
    same = F.col("record_id") == F.col("s_record_id")
    for c in ("position_signature", "source_text", "source_units_json", "source_language", "file_fingerprint"):
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return records.join(s, same, "left_semi")


def identity_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Attachments whose fingerprint is another than before; what was placed for them goes."""
    p = previous.select(*KEY, F.col("file_fingerprint").alias("before"))
    return current.join(p, KEY).where("before <> file_fingerprint").select(*KEY, "before", "file_fingerprint")


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """The last session of each reader; earlier ones are cancelled."""
    w = Window.partitionBy("reader_id").orderBy(F.desc("sequence"))
    return sessions.withColumn("cancelled", F.row_number().over(w) > 1)


def selection_pages(pages: Column, count: Column) -> Column:
    """Distinct pages in range, in order."""
    return F.array_sort(F.array_distinct(F.filter(pages, lambda p: (p >= 0) & (p < count))))


def to_retry(segments: DataFrame, kinds: list[str]) -> DataFrame:
    """Segments of the kinds, to be sent past the store."""
    return segments.where(F.col("kind").isin(*kinds)).withColumn("bypass_cache", F.lit(True))
