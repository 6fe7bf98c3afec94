import re

import pytest
from pyspark.sql import functions as F

from pagewright.functions import hashing as H
from pagewright.functions import predicates as P
from pagewright.functions import text as T


def value(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [("Reliable scientific title", "en"), ("中文标题测试", "zh-CN"), ("123 + =", "unknown"), ("English 中文", "unknown"), (None, "unknown")])
def test_language(spark, text, want):
    assert value(spark, T.detect_language, text) == want


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.normalize, "  ﬁne “q” —​ x ", 'fine "q" - x'), (T.normalize, None, ""), (T.decode_entities, "&amp;lt;&#65;&#x42;&#x110000;", "<AB"), (T.normalize_front_matter, "A&nbsp;<b>B</b>­−C", "a b -c"),
        (T.edge_key, "Page 12 of Volume IV", "# of volume #"), (T.compact_spaced, "A B S T R A C T", "ABSTRACT"), (T.compact_spaced, "A B", "A B"), (T.canonical_heading, "1.2. Methods :", "methods"),
        (T.source_text, " a\r\nb\rc ", "a\nb\nc"), (T.strip_abstract_heading, "Abstract  This is", "this is"), (T.strip_abstract_heading, "摘要 内容", "内容"), (T.strip_abstract_heading, "abstraction", "abstraction"),
        (T.preview, " a<br/>b<i>c</i> ", "a\nbc"), (T.title_parts, "one<br>two", ["one", "two"]), (T.title_parts, "one<br>", None), (T.metadata_id, " undefined ", None), (T.metadata_id, " x ", "x"),
        (T.positive_id, "12", 12.0), (T.positive_id, "-1", None), (T.positive_id, "zz", None), (T.response_json, '```json\n{"a": 1}\n```', '{"a": 1}'), (T.response_json, "none", None), (T.masked_key, "abcdefghij", "abcd***hij"), (T.masked_key, "abc", "***"),
        (lambda c: T.query_string(q=c), "a b&é", "q=a%20b%26%C3%A9"), (lambda c: T.mapped_language(c, T.SHORT_LANGUAGES, "auto"), "ja-JP", "jp"), (lambda c: T.mapped_language(c, T.SHORT_LANGUAGES, "auto"), None, "auto"), (lambda c: T.mapped_language(c, T.WEB_LANGUAGES, "auto", True), "xx-YY", "xx-YY"),
    ],
)
def test_functions(spark, f, text, want):
    assert value(spark, f, text) == want


@pytest.mark.parametrize(
    ("f", "yes", "no"),
    [
        (P.page_number, ["12", "Page 3", "iv", "- 7 -", "3 / 12"], ["12a", "page", "word"]), (P.terminal_heading, ["References", "5. Acknowledgements", "参考文献"], ["Referencesx"]), (P.start_heading, ["1 Introduction", "I n t r o d u c t i o n", "Methods and more"], ["Introductory"]),
        (P.abstract_heading, ["Abstract", "A B S T R A C T", "摘要", "Summary:"], ["Abstract of"]), (P.ends_terminal, ["Done.", "Done.)", "完。 "], ["Done", "a, b"]), (P.front_matter_noise, ["see https://x.y", "a@b.org", "University of X", "doi: 10"], ["plain line"]),
        (P.author_like, ["Anna Berg, Carl Dahl", "a, b c, dd ee ff"], ["A line of text"]), (P.author_name_like, ["Alice Example", "Alice Example a"], ["alice example", "One Two Three"]), (P.abstract_boundary, ["Keywords: x", "Received 3 May", "© 2020".replace(" ", "x")], ["The keywords"]),
        (lambda c: P.numbered_heading(c).isNotNull(), ["1 Introduction", "2.1. Results of It", "IV Data"], ["1 introduction", "3 mm", "0 Zero", "1 Ends here.", "100 Big"]), (lambda c: P.caption_lead(c).isNotNull(), ["Figure 3. A", "表 2: x", "Table A1 - y"], ["Figures", "figure it"]),
    ],
)
def test_predicates(spark, f, yes, no):
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", f(F.col("t")).alias("v")).collect()
    assert {r["t"] for r in rows if r["v"]} == set(yes)


def test_caption_prose(spark):
    lead = lambda t: value(spark, P.caption_lead, t)
    assert lead("Figure 2 shows the result")["prose"] and not lead("Figure 2. Result of it")["prose"] and lead("Table 1: x")["kind"] == "table" and lead("Table 1: x")["strong_separator"]


def test_statuses(spark):
    df = spark.createDataFrame([(200,), (401,), (404,), (429,), (500,)], "s int").select("s", P.retryable(F.col("s")).alias("r"), P.error_code(F.col("s")).alias("c"))
    assert {r["s"]: (r["r"], r["c"]) for r in df.collect()} == {200: (False, None), 401: (False, "provider-authentication"), 404: (False, "provider-http"), 429: (True, "provider-rate-limited"), 500: (True, "provider-rate-limited")}


def plain_hash(text):
    a, b = 2166136261, 3432918353
    for i, c in enumerate(text):
        a = (a ^ ord(c)) * 16777619 % 2**32
        b = (b ^ (ord(c) + i)) * 2246822519 % 2**32
        b = (b << 13 | b >> 19) % 2**32
    return f"{a:08x}{b:08x}"


@pytest.mark.parametrize("text", ["", "a", "Ünïcödé 😀 中文", "x" * 3000])
def test_hash(spark, text):
    assert value(spark, H.stable_hash, text) == plain_hash(text)
    assert value(spark, H.fingerprint, text) == f"{int(plain_hash(text)[:8], 16):x}"


def test_identities(spark):
    rect = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame([(2, "pdf", [(0, None, ["l1"], [3], [(1.0, 2.0, 3.0, 4.5)])])], f"v int, s string, f array<struct<page_index:int,flow_id:string,line_ids:array<string>,line_char_counts:array<int>,rects:array<{rect}>>>")
    text = df.select(H.position_json(F.col("v"), F.col("s"), F.col("f")).alias("j")).first()["j"]
    assert text == '{"version":2,"coordinateSpace":"pdf","fragments":[{"pageIndex":0,"flowID":null,"lineIDs":["l1"],"lineCharCounts":[3],"rects":[["1.000","2.000","3.000","4.500"]]}]}'
    rid = spark.range(1).select(H.record_id(F.lit(1), attachmentKey=F.lit('a"b')).alias("r")).first()["r"]
    assert rid == "translation-" + plain_hash('{"libraryID":1,"attachmentKey":"a\\"b"}')


def test_stats(spark):
    s = value(spark, T.stats, "Ab  12 -3.5 x=y é")
    assert (s["chars"], s["letters"], s["digits"], s["words"], s["numeric_tokens"]) == (len(re.sub(" ", "", "Ab  12 -3.5 x=y é")), 5, 4, 1, 2) and s["operators"] == 2


def test_marks_stand_for_their_patterns(spark):
    texts = [None, "", "plain words", "See HTTP://x", "www.a", "a@b", "@ b", "ORCID", "orcids", "DOI: 1", "doi.org", "© 2020", "Copyright", "All rights  reserved", "see front matter", "Available online", "received 3", "received", "Article history", "关键词", "the COLLEGE", "colleges", "centre", "center", "laboratory", "corresponding author", "ſchool", "a ſchool of fiſh", "faculty", "department", "institute", "universities", "university", "accepted 2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, marks in ((P.NOISE, P.NOISE_MARKS), (P.PUBLISHER, P.PUBLISHER_MARKS), (P.AUTHOR, P.AUTHOR_MARKS)):
        got = df.select("t", P._marked(df["t"], pattern, marks).alias("a"), P._i(df["t"], pattern).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got), [r for r in got if r["a"] != r["b"]]


def test_only_three_letters_or_more_that_stand_alone_become_one_word(spark):
    texts = ["A b s t r a c t", " a  b c ", "a b", "a b cd", "a b 1", "é ü 漢", "a. b c", "", None, "a\u0085 b c", "a b c\u0085d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.compact_spaced(F.col("t"))).collect()] == ["Abstract", "abc", "a b", "a b cd", "a b 1", "éü漢", "a. b c", "", "", "a\u0085bc", "a b c\u0085d"]
