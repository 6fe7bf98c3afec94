"""Byte-level BPE through the tiktoken library and a local rank file.

A long text is cut where no match of the split pattern can cross: before a single
space between two characters that are not white space, since a match may begin with
such a space but never holds one later. Parts are encoded one by one and the ids
joined, so memory follows the part and not the text; ids become raw bytes again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from pagewright.llm.batches import udf_of_lists

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a part, about.
PART = 65_536
#: What the digests of a text are.
CODED = StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("round_trip", "boolean")
SAFE = re.compile(r"(?<=\S) (?=\S)")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str | None = None):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in order, cut at safe places at least ``size`` characters apart."""
    start = 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode_text(enc, text: str | None) -> np.ndarray:
    """Ids of the whole text, as little-endian 32-bit integers."""
    if not text:
        return np.empty(0, "<u4")
    if len(text) <= PART:
        return np.array(enc.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), "<u4") for p in parts(text)])


def decode_ids(enc, ids: np.ndarray) -> bytes:
    """The raw bytes; parts of a character stay as they are."""
    return b"".join(enc.decode_bytes(ids[i : i + PART].tolist()) for i in range(0, len(ids), PART))


def encode_decode(docs: DataFrame, *, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip.

    Null text counts as empty: no ids, both digests of no bytes. Repeated rows and null
    ids give a row each; other columns are not read. ``round_trip`` says whether the
    decoded bytes are the text's UTF-8.
    """

    def digests(enc, text: str) -> dict:
        ids = encode_text(enc, text)
        raw = decode_ids(enc, ids)
        return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(raw).hexdigest(), "round_trip": raw == text.encode()}

    def work(batches: Iterator[list]) -> Iterator[list]:
        enc = encoding(ranks or default_ranks())
        for texts in batches:
            yield [digests(enc, t) for t in texts]

    coded = udf_of_lists(CODED, work)
    out = docs.select(F.col(id_col).alias("doc_id"), coded(F.coalesce(F.col(text_col), F.lit(""))).alias("coded"))
    return out.select("doc_id", "coded.*")


def encode(docs: DataFrame, *, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text; null text has none."""

    def work(batches: Iterator[list]) -> Iterator[list]:
        enc = encoding(ranks or default_ranks())
        for texts in batches:
            yield [encode_text(enc, t).astype("int32") for t in texts]

    ids = udf_of_lists(ArrayType(IntegerType()), work)
    return docs.select(F.col(id_col).alias("doc_id"), ids(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))


def decode(coded: DataFrame, *, ranks: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``coded`` with the raw bytes of its ids in ``decoded``; null and empty ids give no bytes.

    An existing column ``decoded`` is replaced. A null or unknown id within is an error.
    """

    def work(batches: Iterator[list]) -> Iterator[list]:
        enc = encoding(ranks or default_ranks())
        for ids in batches:
            yield [decode_ids(enc, np.asarray(x or [], "<u4")) for x in ids]

    return coded.withColumn("decoded", udf_of_lists(BinaryType(), work)(F.col(ids_col)))
