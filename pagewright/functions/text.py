"""Text normalisation and scalar text functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the texts' producers see it, invisible characters, dashes and quotes.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
DASHES = "‐‑‒–—―"
DOUBLE_QUOTES, SINGLE_QUOTES = "“”„‟", "‘’‚‛"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, for which Spark has no function."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def _plain(c: Column, drop: str, dashes: str) -> Column:
    return F.translate(c, dashes + DOUBLE_QUOTES + SINGLE_QUOTES + drop, "-" * len(dashes) + '"' * 4 + "'" * 4)


def normalize(c: Column, compose: bool | None = True) -> Column:
    """F1. ``compose=False`` leaves out the compatibility composition and so stays out of Python; None takes a text that is normal."""
    if compose is None:
        return c
    text = F.coalesce(c, F.lit(""))
    return squeeze(_plain(nfkc(text) if compose else text, ZERO_WIDTH, DASHES))


#: Named entities in the order in which they are replaced.
ENTITIES = (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'))


@F.pandas_udf(StringType())
def numeric_entities(texts: pd.Series) -> pd.Series:
    """``&#n;`` and ``&#xh;``, those out of range removed."""
    import re

    def one(m):
        n = int(m[1]) if m[1] else int(m[2], 16)
        return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else ""

    return texts.map(lambda t: t if t is None or "&#" not in t else re.sub(r"&#[xX]([0-9a-fA-F]+);", lambda m: one([0, None, m[1]]), re.sub(r"&#([0-9]+);", lambda m: one([0, m[1], None]), t)))


def decode_entities(c: Column, numeric: bool = True) -> Column:
    """named entities one after another (so ``&amp;lt;`` ends as ``<``), then numeric ones."""
    out = F.coalesce(c, F.lit(""))
    for pattern, to in ENTITIES:
        out = F.regexp_replace(out, pattern, to)
    return numeric_entities(out) if numeric else out


def normalize_front_matter(c: Column, compose: bool = True, numeric: bool = True) -> Column:
    """entities, then tags to spaces, dashes, quotes, invisible characters, white space, lower case."""
    text = F.regexp_replace(decode_entities(c, numeric), "<[^>]*>", " ")
    return F.lower(squeeze(_plain(nfkc(text) if compose else text, "\u00ad" + ZERO_WIDTH, DASHES + "\u2212")))


def edge_key(c: Column, compose: bool = True) -> Column:
    """a key under which page headers with other numbers are equal."""
    out = F.lower(normalize(c, compose))
    word = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    for inner in (r"(?:page|p)\.?" + SPACE + r"*[0-9]{1,5}", r"[0-9]{1,5}", r"[ivxlcdm]{1,12}"):
        out = F.regexp_replace(out, word[0] + inner + word[1], " # ")
    return squeeze(out)


def compact_spaced(c: Column, compose: bool = True) -> Column:
    """three or more single letters become one word."""
    text = normalize(c, compose)
    return F.when(text.rlike(r"^ *\p{L}\x85?(?: +\p{L}\x85?){2,} *\z"), F.translate(text, " ", "")).otherwise(text)


def canonical_heading(c: Column, compose: bool = True) -> Column:
    """lower case without leading number and trailing colon or full stop."""
    out = F.regexp_replace(F.lower(compact_spaced(c, compose)), r"^[0-9]+(?:\.[0-9]+)*\.? *", "")
    return F.trim(F.regexp_replace(out, r"[ :：.]+$", ""))


def source_text(c: Column) -> Column:
    """line feeds only, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"), f"^{SPACE}+|{SPACE}+$", "")


def stats(c: Column, compose: bool = True) -> Column:
    """A3: characters but white space, letters, digits, operators, words, ratios and numeric tokens."""
    text = normalize(c, compose)
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    chars, letters, digits, operators = (F.char_length(F.translate(text, " ", "")).cast("long"), count(r"\p{L}"), count(r"\p{N}"), count(r"[=+\-×÷<>≤≥∑∫√^~±∞≈≠∂]"))
    ratio = lambda x: F.when(chars > 0, x / chars).otherwise(F.lit(0.0))
    return F.struct(
        chars.alias("chars"), letters.alias("letters"), digits.alias("digits"), operators.alias("operators"), count(r"\p{L}{2,}").alias("words"),
        ratio(letters).alias("letter_ratio"), ratio(digits).alias("digit_ratio"), ratio(operators).alias("operator_ratio"), count(r"(?:^| )[+-]?[0-9]+(?:[.,][0-9]+)?(?= |$)").alias("numeric_tokens"),
    )


def detect_language(c: Column) -> Column:
    """F8, A4: 'en' or 'zh-CN' by the share of Latin and CJK letters, else 'unknown'."""
    latin, cjk = F.regexp_count(c, F.lit("[A-Za-z]")), F.regexp_count(c, F.lit("[㐀-鿿]"))
    letters = F.coalesce(latin + cjk, F.lit(0))
    return F.when(letters < 4, "unknown").when(latin / letters >= 0.82, "en").when(cjk / letters >= 0.5, "zh-CN").otherwise("unknown")


#: Headings that open an abstract.
ABSTRACT_WORDS = "abstract|summary|摘要|内容摘要"


def strip_abstract_heading(c: Column, compose: bool = True, numeric: bool = True) -> Column:
    """the normalised text without a leading abstract heading."""
    text = normalize_front_matter(c, compose, numeric)
    return F.when(text.rlike(f"^(?:{ABSTRACT_WORDS})(?: |$)"), F.regexp_replace(text, f"^(?:{ABSTRACT_WORDS}) *", "")).otherwise(text)


def preview(c: Column) -> Column:
    """break tags to line feeds, other tags away, trimmed."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)<\s*br\s*/?>", "\n"), "<[^>]+>", "")
    return F.regexp_replace(out, f"^{SPACE}+|{SPACE}+$", "")


def title_parts(c: Column) -> Column:
    """the two parts of a title around one break, else null."""
    parts = F.filter(F.transform(F.split(c, r"(?i)<\s*br\s*/?>"), F.trim), lambda p: p != "")
    return F.when(F.size(parts) == 2, parts)


def metadata_id(c: Column) -> Column:
    """trimmed; empty, 'null' and 'undefined' are null."""
    text = squeeze(c.cast("string"))
    return F.when(~F.lower(text).isin("", "null", "undefined"), text)


def positive_id(c: Column) -> Column:
    """a positive finite number, else null."""
    n = c.try_cast("double")
    return F.when((n > 0) & (n < float("inf")), n)


def response_json(c: Column) -> Column:
    """from the first brace to the last, code fences away; null for none."""
    text = F.trim(F.regexp_replace(c, r"(?im)^```(?:json)?|```$", ""))
    start, back = F.locate("{", text), F.locate("}", F.reverse(text))
    end = F.char_length(text) - back + 1
    return F.when((start > 0) & (back > 0) & (end >= start), F.substring(text, start, end - start + 1))


def query_string(**pairs: Column) -> Column:
    """name=value pairs, percent-encoded with %20 for a space."""
    enc = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(F.coalesce(v.cast("string"), F.lit(""))), r"\+", "%20"), "%21", "!"), "%27", "'"), "%28", "("), "%29", ")")
    return F.concat_ws("&", *[F.concat(F.lit(n + "="), F.regexp_replace(enc(v), "%7E", "~")) for n, v in pairs.items()])


def masked_key(c: Column) -> Column:
    """all stars up to 7 characters, else the first 4 and last 3 with stars between."""
    text = F.trim(F.coalesce(c, F.lit("")))
    n = F.char_length(text)
    return F.when(n <= 7, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(text, 1, 4), F.repeat(F.lit("*"), n - 7), F.substring(text, -3, 3)))


def encrypted_payload(c: Column, key: Column) -> Column:
    """AES-128-ECB with PKCS7 of the UTF-8 bytes, URL-safe base64; the key is always the caller's."""
    return F.translate(F.base64(F.aes_encrypt(c.cast("binary"), key.cast("binary"), F.lit("ECB"), F.lit("PKCS"))), "/+", "_-")


def mapped_language(c: Column, table: dict[str, str], fallback: str, pass_through: bool = False) -> Column:
    """a service's code for a language; the base language stands for a missing variant.

    A missing language is ``fallback``. Unknown ones are null, or themselves if they look like
    a language tag and ``pass_through`` is set.
    """
    codes = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    value = F.trim(F.coalesce(F.when(c != "", c), F.lit(fallback)))
    found = F.coalesce(F.try_element_at(codes, value), F.try_element_at(codes, F.substring_index(value, "-", 1)))
    return F.coalesce(found, F.when(value.rlike("^[A-Za-z][A-Za-z-]*$"), value)) if pass_through else found


#: Language codes of two kinds of service.
WEB_LANGUAGES = {"auto": "auto", "en": "en", "en-US": "en", "en-GB": "en", "zh": "zh-CN", "zh-CN": "zh-CN", "zh-TW": "zh-TW", "ja": "ja", "ko": "ko", "fr": "fr", "de": "de", "es": "es", "pt": "pt", "pt-BR": "pt", "ru": "ru", "ar": "ar", "th": "th", "id": "id", "vi": "vi", "it": "it", "tr": "tr"}
SHORT_LANGUAGES = {"auto": "auto", "en": "en", "en-US": "en", "en-GB": "en", "zh": "zh", "zh-CN": "zh", "zh-TW": "zh-TW", "de": "de", "es": "es", "fr": "fr", "id": "id", "it": "it", "ja": "jp", "ko": "kr", "ms": "ms", "pt": "pt", "ru": "ru", "th": "th", "tr": "tr", "vi": "vi"}


def prompt_version(kind: Column, selection: str, front_matter: str) -> Column:
    """F37."""
    return F.when(kind.isin("custom", "unclassified"), selection).otherwise(front_matter)


def status_line(kind: Column, confidence: Column, method: Column, completeness: Column, coverage: Column) -> Column:
    """``kind: confidence/method[/completeness][ pct%]``."""
    return F.concat(kind, F.lit(": "), F.concat_ws("/", confidence, method, completeness), F.coalesce(F.concat(F.lit(" "), F.floor(coverage * 100 + 0.5).cast("string"), F.lit("%")), F.lit("")))


def parsed_or(c: Column, schema: str, fallback: Column) -> Column:
    """JSON of the schema, the fallback where it is missing or broken."""
    return F.coalesce(F.from_json(F.when(F.trim(c) != "", c), schema, {"mode": "PERMISSIVE"}), fallback)
