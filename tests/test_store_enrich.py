import random
import shutil

import pytest
from pyspark.sql import functions as F

from pagewright.operators import enrich, store
from pagewright.streaming import changes

LOG = "user_id long, seq long, change string, fingerprint string, record string"


def log(spark, *events):
    return spark.createDataFrame([(1, i, *e) for i, e in enumerate(events)], LOG)


def records(spark, *events):
    return sorted((r["record"], r["fingerprint"], r["created"], r["updated"]) for r in store.fold_records(log(spark, *events), key=["user_id"], record="record").collect())


OPEN, OPEN2, UNKNOWN, PUT, DELETE = ("open", "f1", None), ("open", "f2", None), ("open", None, None), ("put", None, "a"), ("delete", None, None)


def test_records_follow_the_log(spark):
    assert records(spark, PUT) == []
    assert records(spark, OPEN, PUT, OPEN, PUT) == [("a", "f1", 1, 3)]
    assert records(spark, OPEN, PUT, OPEN2) == []
    assert records(spark, OPEN, PUT, OPEN2, ("put", None, "b")) == [("b", "f2", 3, 3)]
    assert records(spark, OPEN, PUT, UNKNOWN) == [("a", "f1", 1, 1)]
    assert records(spark, OPEN, PUT, DELETE) == [] and records(spark, OPEN, PUT, DELETE, PUT) == []
    assert records(spark, OPEN, DELETE, OPEN, PUT) == [("a", "f1", 3, 3)]


def test_states_follow_the_log(spark):
    df = log(spark, OPEN, ("trash", None, None), PUT, ("untrash", None, None), ("trash", None, None))
    r = store.fold_log(df, key=["user_id"]).first()
    assert (r["fingerprint"], r["is_trashed"], r["first_seen"], r["last_seen"]) == ("f1", 1, 0, 4)
    assert store.fold_log(log(spark, OPEN, DELETE), key=["user_id"]).count() == 0


def rows(spark, *given):
    base = {"record_id": "r", "library_id": 1, "attachment_key": "k", "file_fingerprint": "f", "segment_kind": "custom", "source_language": "en", "target_language": "zh-CN", "translated_text": "x", "created_at": 1, "updated_at": 1}
    return store.normalized_records(spark.createDataFrame([{**base, **g} for g in given]))


def test_put_is_idempotent_and_keeps_the_first_time(spark):
    old, new = rows(spark, {}), rows(spark, {"translated_text": "y", "created_at": 9, "updated_at": 9}, {"record_id": "blank", "translated_text": " "})
    once = store.put(old, new)
    assert [(r["record_id"], r["translated_text"], r["created_at"]) for r in once.collect()] == [("r", "y", 1)]
    assert sorted(map(tuple, store.put(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_a_new_title_removes_its_siblings(spark):
    old = rows(spark, {"record_id": "t1", "segment_kind": "title"}, {"record_id": "t2", "segment_kind": "title", "file_fingerprint": "other"}, {"record_id": "c"})
    out = store.put(old, rows(spark, {"record_id": "t3", "segment_kind": "title", "updated_at": 5}))
    assert sorted(r["record_id"] for r in out.collect()) == ["c", "t2", "t3"]


def test_purge_trash_sweep(spark):
    states = spark.createDataFrame([(1, "a", 10, 100, 0), (1, "b", 11, 101, 0), (1, "c", None, None, 0)], "library_id long, attachment_key string, attachment_item_id long, parent_item_id long, is_trashed int")
    ids = spark.createDataFrame([("10",), ("101",), ("x",)], "item_id string")
    assert [r["attachment_key"] for r in store.purge_by_ids(states, ids).collect()] == ["c"]
    assert {r["attachment_key"]: r["is_trashed"] for r in store.set_trashed(states, ids, True).collect()} == {"a": 1, "b": 1, "c": 0}
    records = spark.createDataFrame([(1, "a"), (1, "z")], "library_id long, attachment_key string")
    assert [r["attachment_key"] for r in store.sweep_orphans(records, states).collect()] == ["a"]
    items = spark.createDataFrame([(10, False), (11, None)], "item_id long, found boolean")
    kept = store.collect_garbage(records, states, items)
    assert kept[0].count() == 0 and sorted(r["attachment_key"] for r in kept[1].collect()) == ["b", "c"]


def test_reads(spark):
    r = rows(spark, {"position_json": "{}"}, {"record_id": "bad", "position_json": "{broken"}, {"record_id": "t", "segment_kind": "title", "position_json": "{}"})
    attachments = spark.createDataFrame([(1, "k", "f")], "library_id long, attachment_key string, file_fingerprint string")
    assert [x["record_id"] for x in store.list_for_attachment(r, attachments, target_language="zh-CN").collect()] == ["r"]
    got = store.get(r, r.where("record_id = 'r'"), now=F.lit(77)).collect()
    assert [(x["record_id"], x["last_used_at"]) for x in got] == [("r", 77)]
    assert store.get(r, r.where("record_id = 'r'").withColumn("source_hash", F.lit("other")), now=F.lit(1)).count() == 0
    assert store.hydrate(r, r.withColumn("source_text", F.when(F.col("record_id") == "t", "changed").otherwise(F.col("source_text")))).count() == 2


def test_fingerprints(spark):
    df = spark.createDataFrame([(" AB ", 1, 2), ("", 1, 2), (None, None, 2)], "h string, s long, m long").select(store.file_fingerprint(F.col("h"), F.col("s"), F.col("m")).alias("f"))
    assert [r["f"] for r in df.collect()] == ["hash:ab", "stat:1:2", None]


class Failing:
    provider, model = "p", "m"

    def __init__(self, status, times=99):
        self.status, self.left = status, times

    def translate(self, text, session):
        if self.left:
            self.left -= 1
            raise enrich.CallError("network-error" if not self.status else "x", self.status)
        return "ok"


@pytest.mark.parametrize(("status", "times", "calls"), [(429, 1, 2), (0, 1, 2), (401, 1, None)])
def test_retries(status, times, calls):
    t, waits = Failing(status, times), []
    run = lambda: enrich.with_retries(lambda: t.translate("a", {}), sleep=waits.append)
    if calls is None:
        with pytest.raises(enrich.CallError):
            run()
        assert not waits
    else:
        assert run() == "ok" and len(waits) == calls - 1


def test_token_cache():
    now, fetched = [0.0], []
    cache = enrich.TokenCache(lambda: fetched.append(1) or f"t{len(fetched)}", 300, lambda: now[0])
    assert cache.get() == cache.get() == "t1"
    now[0] = 301
    assert cache.get() == "t2"
    assert cache.use(lambda t: t if t == "t3" else (_ for _ in ()).throw(enrich.CallError("auth", 401))) == "t3"


SEGMENTS = "segment_id long, kind string, source_language string, confidence string, source_text string, units array<struct<id:string,source_text:string,break_after:string>>"


def test_enrich(spark):
    units = [("u0", "one", "paragraph"), ("u1", "two", "none")]
    s = spark.createDataFrame([(1, "title", "en", "high", "hello", None), (2, "title", "en", "low", "x", None), (3, "custom", "en", None, "one two", units), (4, "title", "de", "high", "x", None), (5, "abstract", "en", "medium", "kept", None)], SEGMENTS)
    cached = spark.createDataFrame([(5, "stored")], "segment_id long, translated_text string")
    got = {r["segment_id"]: (r["status"], r["translated_text"]) for r in enrich.enrich(s, cached, enrich.Offline()).collect()}
    assert got == {1: ("translated", "[echo] hello"), 2: ("skipped", ""), 3: ("translated", "[echo] one\n\n[echo] two"), 4: ("skipped", ""), 5: ("cached", "stored")}
    assert {r["error_code"] for r in enrich.enrich(s, cached, None).where("segment_id = 1").collect()} == {"no-provider"}
    assert {(r["status"], r["error_code"]) for r in enrich.enrich(s, cached, enrich.Offline(), needs_key=True).where("segment_id = 1").collect()} == {("failed", "missing-key")}
    assert {(r["status"], r["error_code"]) for r in enrich.enrich(s, cached, Failing(401), delays=()).where("segment_id = 1").collect()} == {("failed", "x")}
    assert enrich.enrich(s, cached, enrich.Offline(), bypass_cache=True).where("status = 'cached'").count() == 0
    assert enrich.diagnostics(enrich.enrich(s, cached, enrich.Offline())).first().asDict() == {"total": 5, "cached": 1, "translated": 2, "skipped": 2, "failed": 0}


@pytest.mark.parametrize(
    ("kind", "text", "code"),
    [("title", "译<br>文", None), ("title", "译<br>a<br>文", "multiple-title-breaks"), ("title", "<b>译</b>", "invalid-title-html"), ("title", "译a<br>b文", "invalid-title-break"), ("abstract", "译<br>文", "invalid-abstract-html"), ("abstract", "plain", "invalid-row"), ("custom", "译\n\n文", "invalid-selection-html"), ("custom", "", "invalid-selection-unit"), ("custom", "译文", None)],
)
def test_answers(spark, kind, text, code):
    assert spark.createDataFrame([(kind, text)], "k string, t string").select(enrich.text_error(F.col("k"), F.col("t")).alias("e")).first()["e"] == code


def test_envelopes(spark):
    units = "array<struct<id:string,translatedText:string,breakAfter:string>>"
    df = spark.createDataFrame([("a\n\nb", [("u0", "a", "paragraph"), ("u1", "b", "none")], ["u0", "u1"]), ("a", [("u0", "a", "none")], ["other"])], f"t string, u {units}, ids array<string>")
    out = df.select(enrich.opened_envelope(enrich.envelope(F.col("t"), F.col("u")), F.col("ids")).alias("o")).collect()
    assert out[0]["o"]["translatedText"] == "a\n\nb" and out[1]["o"] is None
    assert df.select(enrich.opened_envelope(F.lit("{broken"), F.col("ids")).alias("o")).first()["o"] is None


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["open", "open", "open", "trash", "untrash", "put", "delete"]
    events = [("1", 0, "open", "f1"), ("2", 1, "open", "g1"), ("1", 2, "trash", None), ("2", 3, "delete", None), ("3", 4, "open", None), ("1", 5, "open", "f2")]
    events += [(str(rng.randint(1, 6)), n, kind := rng.choice(kinds), rng.choice(["f1", "f2", None]) if kind == "open" else None) for n in range(6, 60)]
    src, state, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    for at in range(0, len(events), 10):
        shutil.rmtree(src, ignore_errors=True)  # what was read is never needed again
        spark.createDataFrame([(1, *e) for e in events[at : at + 10]], changes.LOG).coalesce(1).write.parquet(src)
        stream = spark.readStream.schema(changes.LOG).parquet(src)
        changes.start(stream, state, check, full_every=3).awaitTermination()
    batch = store.fold_log(spark.createDataFrame([(1, *e) for e in events], changes.LOG), key=store.KEY)
    names = batch.columns
    want = sorted(map(tuple, batch.collect()))
    assert want and sorted(map(tuple, changes.current(spark, state).select(names).collect())) == want
    full = [e for e, kind in changes._epochs(spark, state) if kind == "full"]
    assert full == [2, 5]
    for e in range(2):  # a full version replaces those before it
        shutil.rmtree(f"{state}/epoch={e}")
    assert sorted(map(tuple, changes.current(spark, state).select(names).collect())) == want
