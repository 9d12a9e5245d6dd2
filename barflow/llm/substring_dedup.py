"""Substring deduplication by recompression.

A text's words are renamed in rounds, each shortening the sequence: first runs of one word
become one symbol, then, round after round, symbols are dealt by a hash of their name to
a left or a right class, and a left symbol followed by a right one becomes one new symbol.
New names are hashes of what they name, so every task gives equal runs and pairs equal
names without asking another. Which symbols arise inside a stretch of text depends on a
few words around each only; that span is tracked. A symbol whose span lies inside a window
of ``WINDOW`` words therefore arises in every copy of the window.

Finding repeats then takes these steps, each a Spark job over all documents:

1. rounds: emit the high-level symbols of each text, by name and span. Windows in which no
   symbol's span fits (long runs) are emitted as they are.
2. names found twice or more, anywhere, are shared. Only windows around a shared span can
   be repeats.
3. verify: those windows are compared by a cryptographic digest (96 bits) of their words
   themselves, not of the words' hashes; the first (by doc_id, start) stays, every later one
   is a repeat.
4. words that a repeat covers are cut.

What is compared goes by hash bucket in packed arrays, after each task has dropped its own
repeats: a name that a third of all documents share is one entry per task. Where there are
more than ``ROUTES`` buckets, entries go by range of buckets first, are gathered and dropped
once more there, and reach their buckets in a second step, so that neither rows become tiny
nor a name that every task knows arrives once for each of them. Document text is shuffled
only for documents with shared spans, and for those that share a ``doc_id``.

Edge cases: null and short texts have no window; rows with one ``doc_id`` count as one
document's versions: each is cut by its own text, and what stands at one start in several
of them is no repeat; their distinct texts are numbered, and positions belong to a number. A
null ``doc_id`` counts as the smallest; empty tables work; extra columns are kept by
``remove_repeats``, whose ``text`` becomes the kept words with one space between where words
went, and stays as it was elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, only_ids, parallelism
from .hashing import GOLD, WordHash, hash_words, mix
from .pretokens import chunks

WINDOW = 20
#: Rounds whose symbols are used: the highest first, the next where those leave windows out.
LEVELS = (6, 5)
#: Entries that a task gathers before it packs them.
FLUSH = 600_000
#: Text whose entries go to one bucket, about.
BUCKET_BYTES = 6_000_000
_NULL_ID = -(2**63)
_FAR = 1 << 40
#: Ranges of buckets that entries are dealt to at once, and tasks that share one range.
ROUTES, SALTS = 256, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


class SpanHash:
    """Hash of any span of a word sequence, from sums of powers (modulo 2^64)."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        n = len(words)
        power, self.back = np.full(n + 1, base), np.full(n + 1, inverse)
        power[0] = self.back[0] = 1
        power, self.back = np.cumprod(power, dtype=np.uint64), np.cumprod(self.back, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:n], dtype=np.uint64)))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo])


class Symbols:
    """The symbols of some documents: names, documents, and the spans they depend on."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        """Level 0: maximal runs of one word."""
        n = len(words)
        same = np.zeros(n, bool)  # as the word before, in one document
        same[1:] = (doc[1:] == doc[:-1])
        equal = same.copy()
        equal[1:] &= words[1:] == words[:-1]
        at = np.flatnonzero(~equal)
        end = np.append(at[1:], n)
        run = (end - at).astype(np.uint64)
        self.name = np.where(run > 1, mix(words[at] + run * GOLD), words[at])
        self.doc = doc[at]
        # a run ends where another word stands: it depends on both neighbours
        self.lo = np.where(same[at], at - 1, -_FAR)
        after = np.append(same, False)[end]
        self.hi = np.where(after, end + 1, _FAR)

    def round(self, level: int) -> None:
        """Pair left symbols with right ones; names and spans follow."""
        name, doc, lo, hi = self.name, self.doc, self.lo, self.hi
        n = len(name)
        right = (mix(name + np.full(1, level, np.uint64) * GOLD) & np.uint64(1)).astype(bool)
        beside = np.zeros(n + 1, bool)  # [i]: symbols i - 1 and i are of one document
        beside[1:n] = doc[1:] == doc[:-1]
        pair = np.zeros(n, bool)
        pair[:-1] = ~right[:-1] & right[1:] & beside[1:n]
        second = np.zeros(n, bool)
        second[1:] = pair[:-1]
        # a symbol left alone depends on the neighbour that did not take it
        after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        other = np.where(right, before, after)
        edge = ~np.where(right, beside[:n], beside[1:]) & ~pair & ~second
        new_lo, new_hi = np.minimum(lo, lo[other]), np.maximum(hi, hi[other])
        new_lo = np.where(edge & right, -_FAR, np.where(edge, lo, new_lo))
        new_hi = np.where(edge & ~right, _FAR, np.where(edge, hi, new_hi))
        new = np.where(pair, mix(name * GOLD + mix(name[after])), name)
        self.name, self.doc, self.lo, self.hi = new[~second], doc[~second], new_lo[~second], new_hi[~second]


def _covered(lo: np.ndarray, hi: np.ndarray, n: int, window: int) -> np.ndarray:
    """[s]: a span [lo, hi) lies inside the window that starts at word s."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, np.maximum(hi - window, 0), 1)
    np.add.at(d, lo + 1, -1)
    return np.cumsum(d)[:n] > 0


def spans(words: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lo, hi, name of the spans to look up: every window holds one at least.

    The name is the symbol's; 0 where a window is looked up as it is.
    """
    n = len(words)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    open_ = np.arange(n) + window <= ends  # windows not yet covered
    if not open_.any():
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    s, kept = Symbols(words, doc), {}
    for level in range(1, max(LEVELS) + 1):
        s.round(level)
        if level in LEVELS:
            fits = (s.hi - s.lo <= window) & (s.lo >= 0)
            kept[level] = s.lo[fits], s.hi[fits], mix(s.name[fits] + np.full(1, level, np.uint64))
    out = []
    for level in sorted(LEVELS, reverse=True):
        lo, hi, name = kept[level]
        # only spans that lie inside a window still open
        opened = np.concatenate(([0], np.cumsum(open_)))
        near = opened[np.minimum(lo + 1, n)] - opened[np.maximum(hi - window, 0)] > 0
        pair, first = np.unique(lo[near] * 64 + (hi - lo)[near], return_index=True)
        lo, hi = pair >> 6, (pair >> 6) + (pair & 63)
        out.append((lo, hi, name[near][first]))
        open_ &= ~_covered(lo, hi, n, window)
    at = np.flatnonzero(open_)
    out.append((at, at + window, np.zeros(len(at), np.uint64)))
    return tuple(np.concatenate(x) for x in zip(*out))


_FIELDS = ("<u8", "<u4", "<i8", "<i8", "<i8", "<u1")


def _pack(*arrays: np.ndarray) -> bytes:
    """h, c (what is compared), doc, tid (which text of it), pos, many (whether another stood for it already)."""
    parts = [np.ascontiguousarray(x, t).tobytes() for x, t in zip(arrays, _FIELDS)]
    return zstandard.ZstdCompressor(level=1).compress(len(arrays[0]).to_bytes(8, "little") + b"".join(parts))


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 8, []
    n = int.from_bytes(raw[:8], "little")
    for t in _FIELDS:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return tuple(out)


_ROWS = "bucket int, known boolean, data binary"


def _sorted(parts: list[tuple]) -> tuple:
    """The entries by what is compared, then by place; where each group starts, and each entry's group."""
    h, c, doc, tid, pos, many = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((tid, pos, doc, c, h))
    h, c, doc, tid, pos, many = (x[order] for x in (h, c, doc, tid, pos, many))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return (h, c, doc, tid, pos, many), np.flatnonzero(new), np.cumsum(new) - 1


def _repeats(entries: tuple, at: np.ndarray, group: np.ndarray, first: bool) -> np.ndarray:
    """Which entries are repeats (``first``: of an earlier place; else of any other) and were not told before."""
    _, _, doc, _, pos, many = entries
    if first:
        return (doc > doc[at][group]) | (pos > pos[at][group])
    return (np.add.reduceat(many.astype(np.int64) + 1, at)[group] > 1) & (many == 0)


class _Gather:
    """Collects entries of a task, drops its own repeats, and packs the rest by bucket or by range of buckets."""

    def __init__(self, buckets: int, first: bool, step: int, most: int):
        self.buckets, self.first, self.step, self.most, self.parts, self.size = buckets, first, step, most, [], 0

    def add(self, *entries: np.ndarray) -> Iterator[pd.DataFrame]:
        self.parts.append(entries)
        self.size += len(entries[0])
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pd.DataFrame]:
        if not self.size:
            return
        entries, at, group = _sorted(self.parts)
        self.parts, self.size = [], 0
        known = _repeats(entries, at, group, self.first)
        bucket = ((entries[0] >> np.uint64(8)) % np.uint64(self.buckets)).astype(np.int64) // self.step * self.step
        rows = []
        if known.any():  # settled here: it passes through any bucket
            k = np.flatnonzero(known)
            k = k[np.lexsort((entries[4][k], entries[3][k], entries[2][k]))]
            none = np.zeros(len(k), np.uint8)
            rows.append((int(bucket[0]), True, _pack(none, none, *(entries[i][k] for i in (2, 3, 4)), none)))
        if self.first:
            stay = np.flatnonzero(~known)  # the first place, in all texts that have it there
        else:
            stay, more = at, np.bincount(group[known], minlength=len(at)) > 0
            entries = *entries[:5], (entries[5] | more[group]).astype(np.uint8)
        order = stay[np.lexsort((entries[4][stay], entries[2][stay], bucket[stay]))]
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
            i = order[a:b]
            rows.append((int(bucket[i[0]]), False, _pack(*(x[i] for x in entries))))
        yield pd.DataFrame(rows, columns=["bucket", "known", "data"])


def _resolve(first: bool):
    """What is repeated among the entries of a bucket: doc, tid, pos."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [_unpack(data)[2:5] for data in pdf.loc[pdf["known"], "data"]]
        packed = [_unpack(x) for x in pdf.loc[~pdf["known"], "data"]]
        if packed:
            entries, at, group = _sorted(packed)
            hit = _repeats(entries, at, group, first)
            found.append(tuple(x[hit] for x in entries[2:5]))
        doc, tid, pos = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"doc": doc, "tid": tid, "pos": pos})

    return one


def _step(buckets: int) -> int:
    """Buckets of a range: 1 while there are ``ROUTES`` at most."""
    return -(-buckets // ROUTES)


def _found(entries: DataFrame, buckets: int, first: bool) -> DataFrame:
    """doc, tid, pos array<long>: what is repeated, of packed entries; one row per text."""
    if _step(buckets) > 1:

        def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, now = _Gather(buckets, first, 1, FLUSH), None
            for df in batches:
                yield df[df["known"]]
                for b, data in df.loc[~df["known"], ["bucket", "data"]].itertuples(index=False):
                    if b != now:
                        yield from out.flush()
                        now = b
                    yield from out.add(*_unpack(data))
            yield from out.flush()

        n = parallelism(entries.sparkSession, ROUTES * SALTS, 1)
        salted = entries.withColumn("_salt", F.spark_partition_id() % SALTS).repartition(n, "bucket", "_salt")
        entries = salted.sortWithinPartitions("bucket").drop("_salt").mapInPandas(again, _ROWS)
    hits = entries.groupBy("bucket").applyInPandas(_resolve(first), "doc long, tid long, pos long")
    return hits.groupBy("doc", "tid").agg(F.collect_list("pos").alias("pos"))


class Texts:
    """The texts of a table: most of a ``doc_id`` of their own (tid 0), some numbered within a shared one."""

    def __init__(self, docs: DataFrame):
        text, doc = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))
        rows = docs.select(F.struct(*docs.columns).alias("row"), doc.alias("doc"), text.alias("text"))
        each = rows.groupBy("doc").agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("n"))
        size, apart = each.agg(F.sum("size"), F.sum((F.col("n") > 1).cast("long"))).first()
        self.size, self.shared = size or 0, None
        self.single = rows
        if apart:
            ids = materialize(each.filter("n > 1").select("doc"), "several")
            self.single = only_ids(rows, ids, "doc", without=True)
            self.shared = only_ids(rows, ids, "doc")
            versions = materialize(self.shared.select("doc", "text").distinct(), "distinct")
            self.versions = materialize(versions.withColumn("tid", F.monotonically_increasing_id() + 1), "versions")

    def all(self) -> DataFrame:
        """doc, tid, text of every distinct text."""
        texts = self.single.select("doc", F.lit(0).cast("long").alias("tid"), "text")
        return texts if self.shared is None else texts.unionByName(self.versions)

    def having(self, found: DataFrame) -> DataFrame:
        """doc, tid, text, pos of the texts in a stored table of doc, tid, pos."""
        own = found.filter("tid = 0").drop("tid")
        texts = only_ids(self.single.select("doc", "text"), own.select("doc"), "doc").join(own, "doc")
        texts = texts.select("doc", F.lit(0).cast("long").alias("tid"), "text", "pos")
        return texts if self.shared is None else texts.unionByName(self.versions.join(found.drop("doc"), "tid").select("doc", "tid", "text", "pos"))

    def rows(self, found: DataFrame) -> DataFrame:
        """row, pos (null where nothing was found) of every row."""
        own, keyed = found.filter("tid = 0").select("doc", "pos"), self.single.select("row", "doc")
        touched = only_ids(keyed, own.select("doc"), "doc").join(own, "doc").select("row", "pos")
        out = touched.unionByName(only_ids(keyed, own.select("doc"), "doc", without=True).select("row", F.lit(None).cast("array<long>").alias("pos")))
        if self.shared is None:
            return out
        numbered = self.shared.join(self.versions, ["doc", "text"]).select("row", "tid")
        return out.unionByName(numbered.join(found.filter("tid > 0").select("tid", "pos"), "tid", "left").select("row", "pos"))


def shared_spans(texts: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """Steps 1 and 2: doc, tid, pos (64 * start + length) of the spans that occur twice or more."""
    step = _step(buckets)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, out = WordHash(), _Gather(buckets, False, step, FLUSH)
        for df in batches:
            ids, tids, texts = df["doc"].to_numpy(), df["tid"].to_numpy(), df["text"].tolist()
            for a, b in chunks(texts):
                words, n = hash_words([t.encode().split() for t in texts[a:b]], memo)
                lo, hi, name = spans(words, n, window)
                if len(lo):
                    starts = np.cumsum(n) - n
                    doc = np.searchsorted(np.cumsum(n), lo, side="right")
                    h = mix(SpanHash(words, _BASE)(lo, hi) + name * GOLD)
                    pos = (lo - starts[doc]) * 64 + hi - lo
                    yield from out.add(h, np.zeros(len(h), np.uint32), ids[a:b][doc], tids[a:b][doc], pos, np.zeros(len(h), np.uint8))
        yield from out.flush()

    return _found(texts.select("doc", "tid", "text").mapInPandas(emit, _ROWS), buckets, first=False)


def _digests(split: list[list[bytes]], doc: np.ndarray, place: np.ndarray, window: int) -> bytes:
    """A digest of 12 bytes of each window's words, joined by one space; ``doc`` ascends."""
    out, digest = [], hashlib.blake2b
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(doc)]):
        words = split[doc[a]]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        whole, at = b" ".join(words), place[a:b]
        lo, hi = (ends[at] - [len(words[i]) + 1 for i in at.tolist()]).tolist(), (ends[at + window - 1] - 1).tolist()
        out += [digest(whole[i:j], digest_size=12).digest() for i, j in zip(lo, hi)]
    return b"".join(out)


def repeated_windows(texts: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """Step 3: doc, tid, pos (starts) of the windows whose words also start earlier, of texts with their shared spans."""
    step = _step(buckets)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Gather(buckets, True, step, FLUSH)
        for df in batches:
            ids, tids, texts = df["doc"].to_numpy(), df["tid"].to_numpy(), df["text"].tolist()
            found = [np.asarray(p, np.int64) for p in df["pos"]]
            for a, b in chunks(texts):
                split = [t.encode().split() for t in texts[a:b]]
                n = np.fromiter(map(len, split), np.int64, b - a)
                starts, total = np.cumsum(n) - n, int(n.sum())
                doc = np.repeat(np.arange(b - a), n)
                pos = np.concatenate([p + 64 * s for p, s in zip(found[a:b], starts)])
                fits = np.arange(total) + window <= np.repeat(np.cumsum(n), n)
                at = np.flatnonzero(fits & _covered(pos >> 6, (pos >> 6) + (pos & 63), total, window))
                if len(at):
                    place = at - starts[doc[at]]
                    digest = np.frombuffer(_digests(split, doc[at], place, window), [("h", "<u8"), ("c", "<u4")])
                    yield from out.add(digest["h"], digest["c"], ids[a:b][doc[at]], tids[a:b][doc[at]], place, np.zeros(len(at), np.uint8))
        yield from out.flush()

    return _found(texts.select("doc", "tid", "text", "pos").mapInPandas(emit, _ROWS), buckets, first=True)


def _cut(text: str, pos, window: int) -> tuple[int, int, str]:
    words = text.encode().split()
    gone = np.zeros(len(words) + 1, np.int64)
    if pos is not None:
        at = np.asarray(pos, np.int64)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + window, -1)
    kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    return len(words), len(words) - len(kept), b" ".join(kept).decode()


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Step 4: one row per row of ``docs``: row (struct of its columns), n_words, n_removed, kept (text)."""
    texts = Texts(docs)
    # a bucket holds the entries of about BUCKET_BYTES of text, however long its documents are
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.size // BUCKET_BYTES)
    shared = materialize(shared_spans(texts.all(), buckets, window), "shared")
    repeats = materialize(repeated_windows(texts.having(shared), buckets, window), "repeats")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(text: pd.Series, pos: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cut(t, p, window) for t, p in zip(text, pos)], columns=["n_words", "n_removed", "kept"])

    out = texts.rows(repeats).withColumn("c", cut(F.coalesce("row.text", F.lit("")), F.col("pos")))
    return out.select("row", "c.*")


def substring_dedup_query(docs: DataFrame) -> DataFrame:
    return cut_repeats(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated stretches cut from ``text``; columns and rows stay."""
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return cut_repeats(docs, window).select(*[text.alias(c) if c == "text" else F.col(f"row.{c}") for c in docs.columns])
