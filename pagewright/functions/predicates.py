"""Classifiers of lines and texts as boolean columns.

Word boundaries are spelled out in ASCII, since engines disagree about them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions.binding import let

END = r"(?![A-Za-z0-9_])"
BEGIN = r"(?<![A-Za-z0-9_])"
#: An ASCII word boundary, whatever stands on either side.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

#: The words that name each kind of line.
PAGE_NUMBER = r"^(?:(?:page|p\.?|页码?) *)?[-()\[\] ]*(?:[0-9]{1,5}|[ivxlcdm]{1,12})(?: */ *[0-9]{1,5})?[-()\[\] ]*$"
TERMINAL_HEADING = r"^(?:references|bibliography|works +cited|literature +cited|acknowledg(?:e)?ments?|funding|author +contributions?|data +availability|conflicts? +of +interest|appendix|supplementary +materials?|参考文献|致谢|基金项目|作者贡献|数据可用性|附录)(?: |$)"
START_HEADING = r"^(?:introduction|background|materials?(?: +and +methods?)?|methods?|methodology|experimental(?: +program)?|theoretical +background|引言|绪论|背景|材料与方法|方法|试验方法)(?: |$)"
ABSTRACT_HEADING = r"^(?:abstract|summary|摘要|内容摘要)$"
NUMBERED = r"^((?:[0-9]+(?:\.[0-9]+){0,3}\.?|[IVXLC]+\.?)) +(.+)$"
UNITS = r"^(?:mm|cm|dm|m|km|mg|g|kg|pa|kpa|mpa|gpa|hz|khz|mhz|s|ms|min|h|day|days|%|°c|k)"
CAPTION = r"^(fig(?:ure)?\.?|table|scheme|chart|plate|图|表) *([A-Z]?[0-9]+(?:[.\-][0-9]+)?|[一二三四五六七八九十百零〇]+)(?: *([.:：\-]) *| +)(.*)$"
CAPTION_VERBS = r"^(?:shows?|illustrates?|presents?|depicts?|compares?|demonstrates?|reveals?|provides?|indicates?|summari[sz]es?|reports?|lists?|gives?|contains?|is|are|was|were)"
CAPTION_SENTENCE = r"^(?:this|these|those|the|we|our|it|they)%s.{0,100}%s(?:evidence(?:s|d)?|show(?:s|ed)?|indicate(?:s|d)?|demonstrate(?:s|d)?|confirm(?:s|ed)?|reveal(?:s|ed)?|suggest(?:s|ed)?|depend(?:s|ed)?|increase(?:s|d)?|decrease(?:s|d)?|is|are|was|were|has|have|had|can|may|will)" % (END, BEGIN)
NOISE = r"(?:https?://|www\.|doi(?:\.org| *:)|" + EDGE + "[^ ]+@[^ ]+" + EDGE + "|" + BEGIN + "orcid" + END + r"|copyright|all +rights +reserved|received +[0-9]|accepted +[0-9]|corresponding +author|university|department|faculty|school|college|institute|关键词)"
PUBLISHER = r"(?:https?://|www\.|doi(?:\.org| *:)|" + EDGE + "[^ ]+@[^ ]+" + EDGE + "|" + BEGIN + "orcid" + END + r"|©|copyright|all +rights +reserved|see +front +matter|available +online|received +[0-9]|accepted +[0-9]|article +history)"
AUTHOR = r"(?:https?://|www\.|" + EDGE + "[^ ]+@[^ ]+" + EDGE + "|" + BEGIN + "(?:university|department|faculty|school|college|institute|laboratory|centre|center|orcid)" + END + ")"
FOOTNOTE = r"^(?:[*∗†‡]|[0-9]{1,2})? *(?:corresponding +author|e-?mail" + END + ")"
ABSTRACT_END = (r"^(?:keywords?|key *words?|article *info|articleinfo)" + END, r"^(?:copyright|all +rights +reserved)" + END, r"^(?:received|accepted|available +online|published +online)" + END)
CONTINUATION = r"^(?:\p{Ll}|(?:and|or|but|while|whereas|which|that|with|of|to|for|from|in)" + END + ")"
COMMON_STEMS = "well|high|low|state|long|short|cross|non|self|co|pre|post|re|multi|two|three|four|five|six|seven|eight|nine|ten"
BODY_WORDS = "is|are|was|were|has|have|can|may|with|for|from|to|of|and|or"


def _i(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?iu)" + pattern), F.lit(False))


#: What a text has, in lower case, that one of the patterns finds.
LINKS = ("://", "www.", "@")
NOISE_MARKS = (*LINKS, "doi", "orcid", "copyright", "reserved", "received", "accepted", "corresponding", "university", "department", "faculty", "school", "college", "institute")
PUBLISHER_MARKS = (*LINKS, "doi", "orcid", "copyright", "reserved", "matter", "available", "received", "accepted", "history")
AUTHOR_MARKS = (*LINKS, "university", "department", "faculty", "school", "college", "institute", "laboratory", "centre", "center", "orcid")


def _marked(c: Column, pattern: str, marks: tuple[str, ...]) -> Column:
    """``_i`` for patterns that need one of ``marks``: ASCII texts without any are told without the pattern."""
    low = lambda t: let(F.lower(t), lambda x: reduce(Column.__or__, [x.contains(m) for m in marks]))
    return let(F.coalesce(c, F.lit("")), lambda t: ((F.octet_length(t) != F.char_length(t)) | low(t)) & t.rlike("(?iu)" + pattern))


def page_number(c: Column, compose: bool = True) -> Column:
    """P1."""
    return _i(T.normalize(c, compose), PAGE_NUMBER)


def terminal_heading(c: Column, compose: bool = True) -> Column:
    """P2."""
    return _i(T.canonical_heading(c, compose), TERMINAL_HEADING)


def start_heading(c: Column, compose: bool = True) -> Column:
    """P3."""
    return _i(T.canonical_heading(c, compose), START_HEADING)


def abstract_heading(c: Column, compose: bool = True) -> Column:
    """P4."""
    return _i(T.canonical_heading(c, compose), ABSTRACT_HEADING)


def ends_terminal(c: Column) -> Column:
    """P8."""
    return F.coalesce(c.rlike(r"[.!?。！？][\])}'\"”’]*" + T.SPACE + "*$"), F.lit(False))


def numbered_heading(c: Column, compose: bool = True) -> Column:
    """P5: struct<prefix, remainder>, null for no numbered heading."""
    text = T.normalize(c, compose)
    prefix, rest = F.regexp_extract(text, "(?iu)" + NUMBERED, 1), F.trim(F.regexp_extract(text, "(?iu)" + NUMBERED, 2))
    first = F.regexp_extract(prefix, r"^([0-9]+)", 1)
    digits = prefix.rlike("^[0-9]")
    number = F.when(digits & (F.char_length(first) <= 9), first.cast("long"))
    fine = (
        (rest != "")
        & (F.char_length(rest) <= 150)
        & ~ends_terminal(rest)
        & (~digits | F.coalesce((number != 0) & (number <= 99), F.lit(False)))
        & ~(digits & _i(rest, UNITS + EDGE))
        & ~rest.rlike(r"^\p{Ll}")
        & ~rest.rlike(r"[.!?。！？] +[\p{Lu}\p{IsHan}]")
        & (F.regexp_count(rest, F.lit(r"\p{L}{2,}")) <= 16)
    )
    return F.when(fine, F.struct(prefix.alias("prefix"), rest.alias("remainder")))


def likely_heading(c: Column, *, font_height: Column, body_height: Column, body_font_fraction: Column, width: Column, flow_width: Column, compose: bool | None = True, numbered: Column | None = None, keyword: Column | None = None) -> Column:
    """P6. ``numbered`` and ``keyword`` are P5 and P2 to P4, where they are known already."""
    text = T.normalize(c, compose)
    ratio = width / F.greatest(F.lit(1.0), flow_width)
    numbered = numbered_heading(c, compose).isNotNull() if numbered is None else numbered
    keyword = keyword if keyword is not None else start_heading(c, compose) | terminal_heading(c, compose) | abstract_heading(c, compose)
    by_keyword = (F.char_length(text) <= 110) & ~ends_terminal(text) & (numbered | (font_height >= body_height * 1.03) | (body_font_fraction < 0.72) | (ratio < 0.56))
    strong = (font_height >= body_height * 1.08) | ((body_font_fraction == 0) & (font_height >= body_height * 1.05)) | (body_font_fraction < 0.50)
    by_number = numbered & ((ratio < 0.72) | (strong & (ratio < 0.90)))
    short = (text != "") & (F.char_length(text) <= 180) & (F.regexp_count(text, F.lit(r"\p{L}{2,}")) <= 18)
    return F.when(keyword, by_keyword).otherwise(by_number) & short  # words are counted last


def caption_lead(c: Column, compose: bool = True) -> Column:
    """struct<kind, remainder, prose, strong_separator>, null for no caption."""
    text = T.normalize(c, compose)
    pattern = "(?iu)" + CAPTION
    kind, sep, rest = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 3), F.trim(F.regexp_extract(text, pattern, 4))
    return F.when(
        text.rlike(pattern),
        F.struct(
            F.when(F.lower(kind).isin("table", "表"), "table").otherwise("figure").alias("kind"),
            rest.alias("remainder"),
            (_i(rest, CAPTION_VERBS + END) | _i(rest, CAPTION_SENTENCE + END)).alias("prose"),
            (sep != "").alias("strong_separator"),
        ),
    )


def math_signals(c: Column, compose: bool = True) -> Column:
    """Strong operators and free-standing minus signs, citation ranges and hyphens left out."""
    text = F.regexp_replace(T.normalize(c, compose), r"(?i)[\[(] *[0-9]+[a-z]?(?: *[-,;] *[0-9]+[a-z]?)* *[\])]", " ")
    text = F.regexp_replace(text, r"(\p{L})-(?=\p{L})", "$1")
    strong, minus = F.regexp_count(text, F.lit(r"[=+×÷<>≤≥∑∫√^~±∞≈≠∂]")), F.regexp_count(text, F.lit(r"(?:^| )- *(?=[\p{L}\p{N}(])"))
    return F.struct(strong.alias("strong"), minus.alias("standalone_minus"), (strong + minus).alias("total"))


def natural_prose(c: Column, compose: bool = True) -> Column:
    """P10."""
    s = T.stats(c, compose)
    return (s["chars"] > 0) & (((s["words"] >= 5) & (s["letter_ratio"] >= 0.52)) | ((s["words"] >= 3) & (s["letter_ratio"] >= 0.64) & _i(T.normalize(c, compose), f"[,.!?;:。！？；：]|{BEGIN}(?:{BODY_WORDS}){END}")))


def body_prose(c: Column, compose: bool = True) -> Column:
    """P10."""
    s = T.stats(c, compose)
    return natural_prose(c, compose) | ((s["words"] >= 3) & (s["letters"] >= 8) & (s["letter_ratio"] >= 0.48) & (math_signals(c, compose)["strong"] == 0))


def continuation_start(c: Column, compose: bool = True) -> Column:
    """P11."""
    return F.coalesce(T.normalize(c, compose).rlike(CONTINUATION), F.lit(False))


def front_matter_noise(c: Column, compose: bool = True) -> Column:
    """P15."""
    return _marked(T.normalize(c, compose), NOISE, NOISE_MARKS)


def artifact_line(c: Column, *, width: Column, font_height: Column, body_height: Column, left_ratio: Column, right_ratio: Column, compose: bool = True) -> Column:
    """P16."""
    compact = F.translate(T.normalize(c, compose), " ", "")
    return (F.char_length(compact) <= 2) & compact.rlike(r"[\p{L}\p{N}]") & (width <= F.greatest(font_height * 1.8, body_height * 2)) & ((font_height >= body_height * 1.35) | (left_ratio > 0.72) | (right_ratio < 0.28))


def author_like(c: Column, compose: bool = True) -> Column:
    """P17."""
    text = T.normalize(c, compose)
    commas = F.regexp_count(text, F.lit(","))
    return _marked(text, AUTHOR, AUTHOR_MARKS) | ((commas >= 2) & (F.regexp_count(text, F.lit(r"\p{L}{2,}")) >= 3)) | ((commas >= 1) & text.rlike(BEGIN + r"[A-Z]\p{Ll}+ +[A-Z]\p{Ll}+" + EDGE))


def author_name_like(c: Column, compose: bool = True) -> Column:
    """Two capitalised words, perhaps one lower-case letter after."""
    return F.coalesce(T.squeeze(F.regexp_replace(T.normalize(c, compose), r"[,*†‡§\[\](){}]", " ")).rlike(r"^[A-Z]\p{Ll}+ [A-Z]\p{Ll}+(?: [a-z])?$"), F.lit(False))


def abstract_boundary(c: Column, compose: bool = True) -> Column:
    """P18."""
    text = T.normalize(c, compose)
    return _i(text, ABSTRACT_END[0]) | _i(text, ABSTRACT_END[1]) | _i(text, ABSTRACT_END[2]) | text.rlike("^©[A-Za-z0-9_]") | _i(T.compact_spaced(c, compose), r"^(?:keywords?|key *words?|articleinfo)[:：]")


def publisher_metadata(c: Column, *, font_height: Column, body_height: Column, top_ratio: Column, bottom_ratio: Column, compose: bool = True) -> Column:
    """P19."""
    text = T.normalize(c, compose)
    return _marked(text, PUBLISHER, PUBLISHER_MARKS) & ((font_height <= body_height * 0.98) | (top_ratio < 0.16) | (bottom_ratio > 0.82) | (F.char_length(text) <= 180))


#: Marks of a publisher's tail.
TAIL = r"(?:©|copyright|all +rights +reserved" + END + ")"


def before_publisher_tail(c: Column) -> Column:
    """F32: what stands before the first mark of a publisher's tail; null where there is none or nothing before it."""
    low = F.lower(c)
    may = (F.octet_length(c) != F.char_length(c)) | low.contains("copyright") | low.contains("reserved")
    return F.when(may, let(F.trim(F.regexp_extract(c, f"(?is)^(.*?){TAIL}", 1)), lambda head: F.when(head != "", head)))


def footnote(c: Column, *, font_height: Column, body_height: Column, bottom_ratio: Column, width_ratio: Column, compose: bool = True) -> Column:
    """P20."""
    text = T.normalize(c, compose)
    return ((bottom_ratio > 0.78) & (font_height < body_height * 0.82) & (width_ratio < 0.72)) | (_i(text, FOOTNOTE) & (F.char_length(text) <= 160) & (width_ratio < 0.78))


def selection_kind(kind: Column) -> Column:
    """P26."""
    return F.coalesce(kind.isin("custom", "unclassified"), F.lit(False))


def eligible(kind: Column, language: Column, source_language: Column, confidence: Column) -> Column:
    """P27."""
    known = selection_kind(kind) | F.coalesce(kind.isin("title", "abstract"), F.lit(False))
    return known & language.eqNullSafe(source_language) & (selection_kind(kind) | F.coalesce(confidence.isin("high", "medium"), F.lit(False)))


def retryable(status: Column) -> Column:
    """P28."""
    return F.coalesce(status.isin(408, 425, 429) | (status >= 500), F.lit(False))


def error_code(status: Column) -> Column:
    """The code of a failed answer, null for a good one."""
    return F.when((status >= 200) & (status < 300), F.lit(None).cast("string")).when(status.isin(401, 403), "provider-authentication").when(retryable(status), "provider-rate-limited").otherwise("provider-http")


def splits_token(left: Column, right: Column) -> Column:
    """A break between two ASCII letters or digits."""
    return F.coalesce(left.rlike("[A-Za-z0-9]$") & right.rlike("^[A-Za-z0-9]"), F.lit(False))


def included(reason: Column) -> Column:
    """Not excluded, or excluded only as front matter."""
    return reason.isNull() | (reason == "front-matter")
