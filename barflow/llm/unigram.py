"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their scores come from a public ``.model`` file; scores are taken as log
scores, and the best segmentation of a text is the one with the largest sum. A space
becomes the marker U+2581, one marker is put in front, and a character that no piece
covers becomes the byte pieces of its UTF-8 form. Decoding reverses all of it.

A text falls apart where no piece can reach across: before every run of markers (a run may be
one piece, or several), and around each character that occurs in no longer piece (as the line
feed). Segmentation works on these units, each distinct one once per worker; the units' bests
add up to the text's best. A model with pieces of several words has no such place before
markers, and its texts are segmented in one go.

Edge cases: null and empty texts give no ids and decode to the empty text; a literal
U+2581 in a text reads as a space, as in the format; ties go to the segmentation found
first from the left; texts are never cut; rows are independent; extra columns pass
through, except that the output columns replace their namesakes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import chunks

MARK = "▁"
MEMO_LIMIT = 500_000
MEMO_UNIT = 64  # longer units are rarely seen twice


@dataclass
class Trie:
    """Double array: node ``s`` has a child by byte ``c`` at ``t = base[s] + c`` if ``check[t] == s``."""

    base: list[int]
    check: list[int]
    value: list[int]  # piece index of the node, or -1

    @classmethod
    def build(cls, keys: list[bytes]) -> Trie:
        children: dict[int, dict[int, int]] = {0: {}}
        ends, count = {}, 1
        for k, key in enumerate(keys):
            s = 0
            for c in key:
                if c not in children[s]:
                    children[s][c] = count
                    children[count] = {}
                    count += 1
                s = children[s][c]
            ends[s] = k
        size = 2 * count + 512
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        place, free, cursor = {0: 0}, 257, 1
        for node in range(count):  # parents come before children
            s = place[node]
            value[s] = ends.get(node, -1)
            kids = sorted(children[node])
            if not kids:
                continue
            if len(kids) == 1:  # fills the holes
                while check[free] != -1:
                    free += 1
                b = free - kids[0]
            else:  # searches on from where the last such node found room
                b = cursor
                while any(check[b + c] != -1 for c in kids):
                    b += 1
                cursor = max(cursor, b - 32)
            more = b + 1024 - len(check)
            if more > 0:
                base += [0] * (more + size)
                check += [-1] * (more + size)
                value += [-1] * (more + size)
            base[s] = b
            for c in kids:
                check[b + c] = s
                place[children[node][c]] = b + c
        return cls(base, check, value)


@dataclass
class Model:
    pieces: list[str]
    trie: Trie
    ids: list[int]  # of the trie's values
    scores: list[float]
    byte_ids: list[int]
    unknown: float

    @classmethod
    def load(cls, data: bytes) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        pieces = list(proto.pieces)
        normal = [(i, p) for i, p in enumerate(pieces) if p.type == 1]
        byte_ids = [next(i for i, p in enumerate(pieces) if p.type == 6 and p.piece == f"<0x{b:02X}>") for b in range(256)]
        return cls(
            [p.piece for p in pieces],
            Trie.build([p.piece.encode() for _, p in normal]),
            [i for i, _ in normal],
            [p.score for _, p in normal],
            byte_ids,
            min(p.score for p in pieces if p.type == 1) - 10.0,
        )

    def unit_pattern(self) -> re.Pattern:
        """Splits a marked text into units that no piece reaches across."""
        inside = {c for i in self.ids for c in self.pieces[i] if len(self.pieces[i]) > 1}
        alone = re.escape("".join(c for c in "\n\r\t" if c not in inside))
        several = any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in self.ids)
        other = f"[^{alone}]+" if several else f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+"
        return re.compile(f"[{alone}]|{other}" if alone else other if not several else "[\\s\\S]+")

    def segment(self, unit: str) -> tuple[int, ...]:
        """Ids of the best segmentation of one unit (Viterbi over its bytes)."""
        text = unit.encode()
        n = len(text)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        best: list = [None] * (n + 1)
        back: list = [None] * (n + 1)
        best[0], size, at = 0.0, len(check), 0
        while at < n:
            c = text[at]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            here, s, one, i = best[at], 0, False, at
            while i < n:
                t = base[s] + text[i]
                if t >= size or check[t] != s or not t:
                    break
                s, i = t, i + 1
                k = value[s]
                if k >= 0:
                    score = here + scores[k]
                    if best[i] is None or score > best[i]:
                        best[i], back[i] = score, (at, k)
                    one = one or i == at + width
                if not base[s]:
                    break
            if not one:
                score, i = here + self.unknown, at + width
                if best[i] is None or score > best[i]:
                    best[i], back[i] = score, (at, -1)
            at += width
        out: list[int] = []
        while n:
            at, k = back[n]
            out += [self.ids[k]] if k >= 0 else [self.byte_ids[b] for b in reversed(text[at:n])]
            n = at
        return tuple(reversed(out))

    def pieces_as_bytes(self) -> list[bytes]:
        as_byte = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        return [as_byte.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]


class Codec(dict):
    """Encodes and decodes texts; remembers each short unit's ids, packed as 32-bit integers."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self._units, self._pieces = model, model.unit_pattern().findall, model.pieces_as_bytes()

    def __missing__(self, unit: str) -> bytes:
        got = np.array(self.model.segment(unit), "<i4").tobytes()
        if len(unit) <= MEMO_UNIT:
            if len(self) >= MEMO_LIMIT:
                self.clear()
            self[unit] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        units = self._units(MARK + text.replace(" ", MARK)) if text else []
        return np.frombuffer(b"".join(map(self.__getitem__, units)), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self._pieces.__getitem__, ids.tolist()))
        return text.decode("utf-8", "replace").removeprefix(" ")


_state: dict[int, Codec] = {}


def codec(data: bytes) -> Codec:
    """The worker's codec for a model file's bytes."""
    key = hash(data)
    if key not in _state:
        _state.clear()
        _state[key] = Codec(Model.load(data))
    return _state[key]


def _source(spark: SparkSession, path: str):
    with open(path, "rb") as f:  # a vocabulary file: its size is fixed, under 1 MB
        return spark.sparkContext.broadcast(f.read())


def encoder(spark: SparkSession, path: str):
    """A function of a text column giving array<int> of piece ids."""
    source = _source(spark, path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(source.value)
        for s in batches:
            yield pd.Series([c.encode(t or "") for t in s], dtype=object)

    return encode


def decoder(spark: SparkSession, path: str):
    """A function of an array<int> column giving the text."""
    source = _source(spark, path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(source.value)
        for s in batches:
            yield pd.Series(["" if x is None else c.decode(x) for x in s], dtype=object)

    return decode


def encode_documents(df: DataFrame, path: str, text_col: str = "text", chars: int = 1_000_000) -> DataFrame:
    """``df`` with ``ids`` array<int> and ``n_tokens``.

    A worker hands its rows on after about ``chars`` characters, so that neither texts nor ids of a
    whole batch are held twice.
    """
    source, rest = _source(df.sparkSession, path), df.drop("ids", "n_tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            for a, b in chunks(texts, chars):
                ids = [c.encode(t) for t in texts[a:b]]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, lists], [*batch.schema.names, "ids"])

    schema = T.StructType([*rest.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rest.mapInArrow(encode, schema).withColumn("n_tokens", F.size("ids").cast("long"))


def decode_documents(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of its ids."""
    return df.withColumn("decoded", decoder(df.sparkSession, path)(F.col(ids_col)))


def encode_and_check(docs: DataFrame, path: str, chars: int = 2_000_000) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and
    round_trip: whether decoding them gives the text back (its U+2581 as spaces).

    A worker hands its rows on after about ``chars`` characters, so no batch is held whole twice.
    """
    source = _source(docs.sparkSession, path)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(source.value)
        for df in batches:
            names, texts = df["doc_id"], df["text"].tolist()
            for a, b in chunks(texts, chars):
                ids = [c.encode(t) for t in texts[a:b]]
                yield pd.DataFrame({
                    "doc_id": names.iloc[a:b].to_numpy(),
                    "ids": pd.Series(ids, dtype=object),
                    "n_tokens": [len(x) for x in ids],
                    "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                    "round_trip": [c.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, texts[a:b])],
                })

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(encode, f"doc_id {kind}, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean")


def unigram_query(docs: DataFrame, path: str) -> DataFrame:
    return encode_and_check(docs, path)
