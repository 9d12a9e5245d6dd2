"""Token ids in binary form: one wavelet matrix per shard.

A shard holds the ids of consecutive documents. Its file is a magic word, a zstandard
frame of the header (document ids, lengths, plane sizes, ones in each block of each plane)
and one zstandard frame per bit plane, inflated when first asked for. Plane ``l`` holds bit
``l`` (from the top) of all ids in the order that the planes above leave: zeros first, then
ones, each in order. With the counts of ones per block, rank and select read one block of a
plane each; they give access to any token, counts and positions of any id, without the ids.

``write_shards`` puts documents in ascending ``doc_id`` order by a range partitioning,
encodes and writes them; the files are rows of a Parquet folder, so that Spark's commit
protocol covers them in any store and a lost executor leaves no half file.

Edge cases: null text is empty (its document holds the end id alone); empty tables give
no shards; repeated ``doc_id``s stay separate documents, ordered by text; a null
``doc_id`` comes first; a document is never split, so one longer than a shard makes a
longer shard; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parallelism, shared_dir
from .pretokens import classes, word_level

MAGIC = b"WVM1"
#: Ids in a shard, at least, unless the data end: 2 bytes each, so that work stays in cache.
SHARD_IDS = 1 << 17
#: Text of a part, about, and characters of it that rows of one id are parted by.
PART_BYTES, HEAD = 64_000_000, 64
BLOCK = 512  # ids between two rank counts
MEMO_LIMIT = 1_000_000
_NULL_ID = -(2**63)
#: How byte-level models write bytes: printable ones as themselves, the others from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_state: dict[int, tuple] = {}


def block_ones(plane: np.ndarray) -> np.ndarray:
    """Ones in each block of a plane."""
    if not len(plane):
        return np.zeros(0, np.uint16)
    return np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK // 8), dtype=np.uint16)


class WaveletMatrix:
    """Rank, select and access over a sequence of ids, kept as bit planes (arrays, or functions that give them)."""

    def __init__(self, n: int, planes: list, zeros: list[int], ones: list[np.ndarray]):
        self.n, self.zeros, self.ones, self._planes = n, zeros, ones, planes
        self._ranks: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (x & x.dtype.type(1 << b)).view(x.dtype) != 0
            planes.append(np.packbits(one))
            low, high = x[~one], x[one]
            zeros.append(len(low))
            x[: len(low)], x[len(low) :] = low, high
        return cls(len(ids), planes, zeros, [block_ones(p) for p in planes])

    def plane(self, level: int) -> np.ndarray:
        if callable(self._planes[level]):
            self._planes[level] = self._planes[level]()
        return self._planes[level]

    def _upto(self, level: int) -> np.ndarray:
        """Ones before each block of a plane."""
        if self._ranks[level] is None:
            self._ranks[level] = np.concatenate(([0], np.cumsum(self.ones[level], dtype=np.int64)))
        return self._ranks[level]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        k = i // BLOCK
        part = np.unpackbits(self.plane(level)[k * BLOCK // 8 : (i + 7) // 8])[: i - k * BLOCK] if i % BLOCK else ()
        return int(self._upto(level)[k]) + int(np.sum(part, dtype=np.int64))

    def _select(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Where the ``nth`` (from 0, ascending) ones or zeros of a plane stand."""
        before = self._upto(level)
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block, out = np.searchsorted(before, nth, side="right") - 1, np.empty(len(nth), np.int64)
        first = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(nth)]):
            k = int(block[a])
            inside = np.unpackbits(self.plane(level)[k * BLOCK // 8 : (k + 1) * BLOCK // 8])[: self.n - k * BLOCK]
            out[a:b] = k * BLOCK + np.flatnonzero(inside == bit)[nth[a:b] - before[k]]
        return out

    def access(self, i: int) -> int:
        value = 0
        for level, z in enumerate(self.zeros):
            bit = self.plane(level)[i >> 3] >> (7 - (i & 7)) & 1
            ones = self._rank1(level, i)
            value, i = value << 1 | int(bit), z + ones if bit else i - ones
        return value

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` among the first ``i`` ids."""
        lo, hi = self._range(value, i)
        return hi - lo

    def _range(self, value: int, hi: int) -> tuple[int, int]:
        lo, bits = 0, len(self.zeros)
        if value >> bits:
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (z + a, z + b) if value >> (bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def positions(self, value: int) -> list[int]:
        """Where ``value`` occurs, ascending: its block on the last level, selected upward."""
        lo, hi = self._range(value, self.n)
        at, bits = np.arange(lo, hi), len(self.zeros)
        for level in range(bits - 1, -1, -1):
            bit = value >> (bits - 1 - level) & 1
            at = self._select(level, bit, at - (self.zeros[level] if bit else 0))
        return at.tolist()

    def decode(self) -> np.ndarray:
        """All ids: from the last plane up, zeros and ones go back to their places."""
        bits = len(self.zeros)
        v = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            one = np.unpackbits(self.plane(level), count=self.n).view(bool)
            z, out = self.zeros[level], np.empty_like(v)
            out[~one] = v[:z]
            out[one] = v[z:] | v.dtype.type(1 << (bits - 1 - level))
            v = out
        return v


def shard_bytes(doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    m, c = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1)
    planes = [c.compress(m.plane(level).tobytes()) for level in range(len(m.zeros))]
    head = c.compress(
        struct.pack("<QIQ", m.n, len(planes), len(doc_ids))
        + np.array(m.zeros + [len(p) for p in planes], "<u8").tobytes()
        + np.array(doc_ids, "<i8").tobytes() + np.array(lengths, "<u8").tobytes()
        + np.concatenate(m.ones).astype("<u2").tobytes()
    )
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(planes)


def open_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids, their lengths, and the ids' wavelet matrix, from a shard file's bytes."""
    if data[:4] != MAGIC:
        raise ValueError("not a token shard")
    size = struct.unpack("<I", data[4:8])[0]
    head, at = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]), 8 + size
    n, bits, docs = struct.unpack("<QIQ", head[:20])
    rest = np.frombuffer(head, "<i8", offset=20, count=2 * bits + 2 * docs)
    ones = np.frombuffer(head, "<u2", offset=20 + rest.nbytes).reshape(bits, -1)
    planes = []
    for k in rest[bits : 2 * bits].tolist():
        planes.append(lambda a=at, b=at + k: np.frombuffer(zstandard.ZstdDecompressor().decompress(data[a:b]), np.uint8))
        at += k
    return rest[2 * bits : 2 * bits + docs], rest[2 * bits + docs :], WaveletMatrix(n, planes, rest[:bits].tolist(), list(ones))


class Merged(dict):
    """Pre-token -> its ids' bytes, merged by the library's model when first asked for; forgets all at ``MEMO_LIMIT``."""

    def __init__(self, merge, kind: str):
        super().__init__()
        self.merge, self.kind = merge, kind

    def __missing__(self, w: str) -> bytes:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        t = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(_BYTES)
        ids = self[w] = array(self.kind, [x.id for x in self.merge(t)]).tobytes()
        return ids


def _load(source: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(source)
    if key not in _state:
        _state.clear()
        tok = Tokenizer.from_buffer(source)
        width = "<u2" if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        merged = Merged(tok.model.tokenize, "H" if width == "<u2" else "I")
        _state[key] = tok, merged, [t.content for t in tok.get_added_tokens_decoder().values()], width
    return _state[key]


def encode_texts(source: bytes, texts: list[str]) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned integers of 16 bits (32 for a vocabulary beyond them).

    A pre-token's ids do not depend on its neighbours, so each distinct one is merged by
    the library's model once and remembered. Texts that hold special strings, odd characters, text
    that normalisation would recompose, or a capital sigma (whose lower case depends on
    context) are encoded whole by the library.
    """
    tok, merged, special, width = _load(source)
    firsts, odd, split, ids = {s[0] for s in special}, classes()[2], word_level(), merged.__getitem__
    for t in texts:
        plain = unicodedata.is_normalized("NFC", t) and "Σ" not in t and not odd.search(t)
        if plain and not (any(c in t for c in firsts) and any(s in t for s in special)):
            yield b"".join(map(ids, split.findall(t.lower())))
        else:
            yield np.array(tok.encode(t, add_special_tokens=False).ids, width).tobytes()


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``path`` as wavelet shards.

    Columns: part, shard (order of the shards), n_ids, data (the shard file).
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:  # a vocabulary file: its size is fixed, about 2 MB
        source = spark.sparkContext.broadcast(f.read())

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = np.dtype(_load(source.value)[3])
        end = np.array([end_id], width).tobytes()
        part, shard, names, parts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(parts), width)
            data = shard_bytes(names, [len(p) // width.itemsize for p in parts], ids)
            return pd.DataFrame({"part": [part], "shard": [shard], "n_ids": [len(ids)], "data": [data]})

        for df in batches:
            for doc_id, ids in zip(df["id"].tolist(), encode_texts(source.value, df["text"].tolist())):
                names.append(doc_id)
                parts.append(ids + end)
                size += len(ids) // width.itemsize + 1
                if size >= shard_ids:
                    yield flush()
                    shard, names, parts, size = shard + 1, [], [], 0
        if parts:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # rows without an id are many or few: texts part them, by a prefix that keeps the order of texts
    rows = rows.withColumn("_head", F.substring("text", 1, HEAD))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = parallelism(spark, size, PART_BYTES)
    rows.repartitionByRange(n, "id", "_head").sortWithinPartitions("id", "text").select("id", "text").mapInPandas(
        shards, "part int, shard int, n_ids long, data binary"
    ).write.option("compression", "uncompressed").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the shard files."""
    shards = spark.read.schema("part int, shard int, n_ids long, data binary").parquet(path)

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for part, shard, data in zip(df["part"], df["shard"], df["data"]):
                doc_ids, lengths, matrix = open_shard(data)
                ids = matrix.decode().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * int(e - k) : 4 * int(e)]) for e, k in zip(ends, lengths)]
                yield pd.DataFrame(
                    {"part": part, "shard": shard, "id": doc_ids, "at": ends - lengths, "n_tokens": lengths, "ids_crc32": crc}
                )

    docs = shards.select("part", "shard", "data").mapInPandas(
        documents, "part int, shard int, id long, at long, n_tokens long, ids_crc32 long"
    )
    # where a shard starts: sums within its part, then over the parts (one row each)
    meta = shards.select("part", "shard", "n_ids")
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = meta.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(over_parts), F.lit(0)).alias("part_start")
    )
    starts = meta.select("part", "shard", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("in_part")).join(parts, "part")
    return docs.join(starts, ["part", "shard"]).select(
        F.when(F.col("id") != _NULL_ID, F.col("id")).alias("doc_id"),
        (F.col("part_start") + F.col("in_part") + F.col("at")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def token_shard_query(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    path = shared_dir(docs.sparkSession) + "/shards"
    write_shards(docs.select("doc_id", "text"), path, tokenizer, end_id)
    return read_documents(docs.sparkSession, path)
