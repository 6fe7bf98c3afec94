"""Media columns: payloads in tar shards, addressed by content; rows carry references.

``pack_media`` stores each text's payload as a lossless 8-bit greyscale PNG in tar shards
in the shared folder; members are named by the SHA-256 of their bytes. Rows carry digest,
shard, offset and length. ``with_header`` reads the first bytes of a member only and fills
metadata columns; ``with_features`` reads the whole member back, decodes it and computes
features.

A task writes shards under names of its own, and the rows of a task that failed or was
repeated are never committed, so a lost executor leaves files that nothing refers to. A
task stores a content once (of its last REMEMBERED); tasks don't know each other's, so all
rows of a content are then pointed to one of its places, whichever task wrote it: in the
whole store a digest has one address. Members that no row refers to stay in their shard.
"""

from __future__ import annotations

import hashlib
import tarfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from pagewright.session import new_path, write_table

UNIT, PAD = 576, b"\xff"
SHARD_BYTES = 256 << 20
LEVEL = 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, length and name of the first chunk, its 13 bytes and checksum.
HEADER_BYTES = 33
#: Contents whose place a task remembers.
REMEMBERED = 200_000


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, padded to a positive multiple of UNIT, and their number before."""
    raw = (text or "").encode()
    return raw + PAD * (-len(raw) % UNIT if raw else UNIT), len(raw)


def _chunk(name: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image of UNIT columns whose samples are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    head = UNIT.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER_BYTES."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big"), head[24]


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` made."""
    width, height, _ = png_header(image)
    data, at = [], 8
    while at < len(image):
        n = int.from_bytes(image[at : at + 4], "big")
        if image[at + 4 : at + 8] == b"IDAT":
            data.append(image[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Shards:
    """Writes members to tar shards of this task, a new one when one is full."""

    def __init__(self, folder: str):
        self.store, self.folder = _store(folder)
        self.out, self.uri = None, folder

    def put(self, name: str, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.store.create_dir(self.folder, recursive=True)
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.GNU_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        offset, self.at = self.at + len(head), self.at + len(head) + len(data) + -len(data) % 512
        return f"{self.uri}/{self.name}", offset

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


@lru_cache(maxsize=16)
def _opened(shard: str):
    store, path = _store(shard)
    return store.open_input_file(path)


def read_range(shard: str, offset: int, length: int) -> bytes:
    f = _opened(shard)
    f.seek(offset)
    return f.read(length)


def pack_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length of every row; a digest has one place.

    Null text is empty and gets one unit of padding. Null ids and repeated rows have a row
    each; equal texts have equal digests and lengths. Other columns are not read.
    """
    folder = new_path(docs.sparkSession, "media")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards, seen = _Shards(folder), OrderedDict()
        try:
            for batch in batches:
                rows = []
                for text in batch["text"]:
                    payload, n = payload_of(text)
                    key = hashlib.sha256(payload).digest()
                    if key not in seen:
                        image = to_png(payload)
                        digest = hashlib.sha256(image).hexdigest()
                        seen[key] = (digest, *shards.put(f"{digest}.png", image), len(image))
                        if len(seen) > REMEMBERED:
                            seen.popitem(last=False)
                    rows.append((n, *seen[key]))
                yield pd.DataFrame(rows, columns=["n_bytes", "digest", "shard", "offset", "length"]).assign(doc_id=batch["doc_id"].to_numpy())[["doc_id", "n_bytes", "digest", "shard", "offset", "length"]]
        finally:
            shards.close()

    kind = dict(docs.dtypes)["doc_id"]
    packed = docs.select("doc_id", "text").mapInPandas(pack, f"doc_id {kind}, n_bytes long, digest string, shard string, offset long, length long")
    rows = write_table(packed, "media-rows")  # written, so that no place changes when read again
    places = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset")).alias("place"))
    return rows.drop("shard", "offset").join(places, "digest").select("doc_id", "n_bytes", "digest", "place.shard", "place.offset", "length")


def _with(media: DataFrame, kind: StructType, of, *columns: str) -> DataFrame:
    """``media`` with the fields that ``of`` gives for the values of ``columns``; columns of these names are replaced."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def read(arrays: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in arrays:
            seen = OrderedDict()
            for at in zip(*(a.to_pylist() for a in batch), strict=True):
                if at not in seen:
                    seen[at] = dict.fromkeys(kind.names) if None in at else dict(zip(kind.names, of(*at), strict=True))
            yield pa.array([seen[at] for at in zip(*(a.to_pylist() for a in batch), strict=True)], arrow)

    kept = [c for c in media.columns if c not in kind.names]
    return media.select(*kept, read(*columns).alias("__read")).select(*kept, "__read.*")


HEADER = StructType().add("width", "integer").add("height", "integer").add("sample_bits", "integer")


def with_header(media: DataFrame) -> DataFrame:
    """``media`` with width, height and sample_bits, from the first bytes of each member.

    A null shard or offset gives nulls; columns of these names are replaced. A member that is
    no PNG is an error.
    """
    return _with(media, HEADER, lambda shard, offset: png_header(read_range(shard, offset, HEADER_BYTES)), "shard", "offset")


def features(payload: bytes) -> str:
    """Mean and entropy of the samples, how many differ, and the commonest."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean = float((counts * np.arange(256)).sum()) / len(payload)
    return f"mean={mean:.6f};entropy={abs(-(share * np.log2(share)).sum()):.6f};levels={len(share)};mode={int(counts.argmax())}"


FOUND = StructType().add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("feature", "string")


def _found(shard: str, offset: int, length: int) -> tuple:
    image = read_range(shard, offset, length)
    payload = from_png(image)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), features(payload)


def with_features(media: DataFrame) -> DataFrame:
    """``media`` with what the members' bytes give when read back; a place is read once a batch.

    A null shard, offset or length gives nulls; columns of these names are replaced.
    """
    return _with(media, FOUND, _found, "shard", "offset", "length")


def media_columns(docs: DataFrame) -> DataFrame:
    """Pack every text, fill the header columns and read all members back (see the parts)."""
    found = with_features(with_header(pack_media(docs)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "sample_bits")
