"""Token counts for a sentencepiece BPE model, with a shortcut for whole tokens.

The library merges over the whole text, but no merge can cross the start of a run of
word marks unless some vocabulary string holds a mark after another character. That is
checked when the model is loaded, as is the same for line feeds. Pre-tokens between
such places can therefore be counted apart: those that the library is shown (at load
time, once a worker) to encode alone as one token cost one lookup, the rest go through
the library's merges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pagewright.llm.batches import udf_of_lists

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
#: Entries of merged pre-tokens that a worker keeps, and the longest that it keeps.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class PieceCounter:
    """Counts tokens of texts as ``SentencePieceProcessor.encode`` gives them."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        self.splits = (
            not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
            and not any("\n" in p for p in pieces)
            and self.sp.encode("a  b c", out_type=str) == [x for part in ("a", " b", "c") for x in self.sp.encode(part, out_type=str)]
            and self.sp.encode("\n", out_type=str) == [MARK, "<0x0A>"]
        )
        self.pattern = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
        self.proved = {"\n": 1}
        if self.splits:
            ordinary = set(pieces)
            own = [(i, p) for i, p in enumerate(self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())) if p in ordinary]
            asked = [p[1:] if p[0] == MARK else "\n" + p for _, p in own]
            for (i, p), ids in zip(own, self.sp.encode([a.replace(MARK, " ") for a in asked], num_threads=1), strict=True):
                if ids == [i] if p[0] == MARK else ids[2:] == [i]:
                    self.proved[p] = 1
        self.kept = dict(self.proved)

    def merged(self, pre: str) -> int:
        """Tokens of one pre-token, by the library's merges."""
        if pre[0] == MARK:
            return len(self.sp.encode(pre[1:].replace(MARK, " "))) if len(pre) > 1 else 1
        return len(self.sp.encode("\n" + pre)) - 2

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.sp.encode(text))
        found = self.pattern.findall(MARK + text.replace(" ", MARK))
        counts = list(map(self.kept.get, found))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    pre = found[i]
                    n = self.kept.get(pre)
                    if n is None:
                        n = self.merged(pre)
                        if len(pre) <= CACHE_CHARS:
                            if len(self.kept) > CACHE_ENTRIES:
                                self.kept = dict(self.proved)
                            self.kept[pre] = n
                    counts[i] = n
        return sum(counts)


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, *, model: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null text counts as empty: no bytes, no tokens. Repeated rows and null ids give a row
    each; other columns of ``docs`` are not read. ``model`` is a file that every executor
    has; by default the public one is looked up where the task runs.
    """

    def counted(batches: Iterator[list]) -> Iterator[list]:
        counts = counter(model or default_model())
        for texts in batches:
            yield [counts.count(t) for t in texts]

    n_tokens = udf_of_lists(LongType(), counted)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
