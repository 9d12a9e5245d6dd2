"""Source divergence audit: which words set each source of a language apart.

1. sketch: every task counts, for each (language, term), the documents of its part of the
   table that have it, into a count-min sketch of small saturating cells. The sketches are
   merged by block of cells in one sorted stream, and what is kept of the sum is one bit a
   cell: whether it reached ``MIN_DOCS``. These bits (``DEPTH * WIDTH / 8`` bytes, whatever the
   corpus) go to every task. A count-min sketch never underestimates, so a term with a bit missing
   is rare for certain.
2. count: the table is read again; a task adds up its own counts by (language, source,
   term) and drops the terms that are rare for certain before anything is shuffled. Survivors
   are counted exactly, and those in enough documents of their language are kept. (A task
   stops counting a term's documents at ``MIN_DOCS``: the sum reaches it all the same.)
3. shares: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), in whole numbers throughout. A source's
   absent terms all have one share, p0.
4. pairs: the sum of f(p, q) over all terms of two sources is a sum over their terms as if
   the other lacked them (by distinct share, of which a source has few), plus the terms that both
   lack, plus a correction for the terms that both have. Only that correction needs a join of
   terms, and it is a sparse one.

Edge cases: null text, lang and source are empty ones; a row is a document, whatever its id; a
source without terms has p0 for each of them; a language without kept terms has
pairs of value 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism
from .hashing import GOLD, mix

MIN_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Cells of a row of the sketch, and its rows. Wider ones drop more of a larger vocabulary.
WIDTH, DEPTH = 1 << 24, 3
#: Cells of a block, the unit of merging.
BLOCK = 1 << 18
#: Entries of a task's counts before they are handed on.
FLUSH = 1_000_000
#: Rows of a table of sources that are broadcast, at most.
MAX_BROADCAST_SOURCES = 100_000

_NOT_TERM = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122))
_FOLD = bytes.maketrans(_NOT_TERM + bytes(range(65, 91)), b" " * len(_NOT_TERM) + bytes(range(97, 123)))


def terms(text: str) -> list[bytes]:
    """Matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, only A-Z lower-cased."""
    return text.encode().translate(_FOLD).split()


def _cells(lang: bytes, found: list[bytes], width: int, depth: int) -> np.ndarray:
    """[row, i]: the cell of each term in each row of the sketch."""
    h = np.fromiter((xxhash.xxh64_intdigest(lang + b"\x00" + t) for t in found), np.uint64, len(found))
    return np.stack([(mix(h + np.full(1, k, np.uint64) * GOLD) % np.uint64(width)).astype(np.int64) for k in range(depth)])


class _Frequencies:
    """Documents of each term of a language, counted up to ``least``: what has reached it is passed over."""

    def __init__(self, least: int):
        self.least, self.counts, self.full, self.seen = least, Counter(), set(), 0

    def add(self, found: set[bytes]) -> None:
        self.counts.update(found - self.full)
        self.seen += 1
        if self.seen & 127 == 0:
            self.full.update(t for t, n in self.counts.items() if n >= self.least)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


class _Sketch:
    """A task's count-min sketch; cells stop at the number that is asked for."""

    def __init__(self, least: int, width: int, depth: int):
        kind = next(t for t in (np.uint8, np.uint16, np.uint32) if least <= np.iinfo(t).max)
        self.least, self.width, self.depth = least, width, depth
        self.cells = np.zeros((depth, width), kind)

    def add(self, lang: str, counts: Counter) -> None:
        n = np.fromiter(counts.values(), np.int64, len(counts))
        for row, at in zip(self.cells, _cells(lang.encode(), list(counts), self.width, self.depth)):
            order = np.argsort(at, kind="stable")
            cell, first = np.unique(at[order], return_index=True)
            row[cell] = np.minimum(np.add.reduceat(n[order], first) + row[cell], self.least)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        pack = zstandard.ZstdCompressor(level=1)
        for i, block in enumerate(self.cells.reshape(-1, min(BLOCK, self.width))):
            if block.any():
                yield i, pack.compress(block.tobytes())


def sketch(docs: DataFrame, least: int = MIN_DOCS, width: int = WIDTH, depth: int = DEPTH) -> np.ndarray:
    """The merged sketch as bits, [row, cell // 8]: whether ``least`` documents may have a term of the cell."""
    block, kind = min(BLOCK, width), _Sketch(least, 8, 1).cells.dtype

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, langs, size = _Sketch(least, width, depth), defaultdict(lambda: _Frequencies(least)), 0
        for df in batches:
            for lang, text in zip(df["lang"], df["text"]):
                f = langs[lang]
                size -= len(f.counts)
                f.add(set(terms(text)))
                size += len(f.counts)
                if size >= FLUSH:
                    for k, f in langs.items():
                        out.add(k, f.counts)
                    langs.clear()
                    size = 0
        for k, f in langs.items():
            out.add(k, f.counts)
        yield pd.DataFrame(out.blocks(), columns=["block", "data"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One block after the other, each the sum of what the tasks sent."""
        unpack, now, total = zstandard.ZstdDecompressor(), None, None
        for df in batches:
            for b, data in zip(df["block"], df["data"]):
                if b != now:
                    if now is not None:
                        yield pd.DataFrame([(now, np.packbits(total >= least).tobytes())], columns=["block", "bits"])
                    now, total = b, np.zeros(block, np.int64)
                total = np.minimum(total + np.frombuffer(unpack.decompress(data), kind), least)
        if now is not None:
            yield pd.DataFrame([(now, np.packbits(total >= least).tobytes())], columns=["block", "bits"])

    n = min(depth * (width // block), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = _texts(docs).select("lang", "text").mapInPandas(count, "block int, data binary")
    merged = parts.repartition(n, "block").sortWithinPartitions("block").mapInPandas(merge, "block int, bits binary")
    bits = np.zeros((depth * (width // block), block // 8), np.uint8)
    for b, data in merged.collect():  # bits only: depth * width / 8 bytes
        bits[b] = np.frombuffer(data, np.uint8)
    return bits.reshape(depth, -1)


def may_be_kept(bits: np.ndarray, lang: str, found: list[bytes]) -> np.ndarray:
    """Which terms the sketch can't rule out."""
    depth, width = bits.shape[0], bits.shape[1] * 8
    out = np.ones(len(found), bool)
    for row, at in zip(bits, _cells(lang.encode(), found, width, depth)):
        out &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


class _Counts:
    """A task's counts by source and term, and documents by term, of the terms that may be kept."""

    def __init__(self, bits: np.ndarray, least: int):
        self.bits, self.verdicts, self.size = bits, defaultdict(dict), 0
        self.sources, self.langs = defaultdict(Counter), defaultdict(lambda: _Frequencies(least))

    def add(self, lang: str, source: str, found: list[bytes]) -> None:
        n = self.sources[lang, source]
        self.size -= len(n)
        n.update(found)
        self.size += len(n)
        self.langs[lang].add(set(found))

    def _rows(self, lang: str, source: str | None, counts: Counter) -> pa.RecordBatch:
        verdicts = self.verdicts[lang]
        new = [t for t in counts if t not in verdicts]
        verdicts.update(zip(new, may_be_kept(self.bits, lang, new).tolist()))
        kept = [(t, n) for t, n in counts.items() if verdicts[t]]
        columns = [pa.repeat(pa.scalar(x, pa.string()), len(kept)) for x in (lang, source)]
        columns += [pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n"])

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in self.sources.items():
            yield self._rows(lang, source, counts)
        for lang, f in self.langs.items():
            yield self._rows(lang, None, f.counts)
        for x in (self.sources, self.langs, self.verdicts):
            x.clear()
        self.size = 0


def kept_counts(docs: DataFrame, least: int = MIN_DOCS, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """lang, source, term, n: exact counts of the terms in at least ``least`` documents of their language."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(sketch(docs, least, width, depth))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(bits.value, least)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                counts.add(*row[:2], terms(row[2]))
                if counts.size >= FLUSH:
                    yield from counts.flush()
        yield from counts.flush()

    # a row without a source has the documents of its term
    survivors = _texts(docs).mapInArrow(count, "lang string, source string, term string, n long")
    # one exchange for the sums by source and by language: both lie within a term's partition
    n = parallelism(spark, 0, 1)
    exact = survivors.repartition(n, "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    in_docs = F.max(F.when(F.col("source").isNull(), F.col("n"))).over(Window.partitionBy("lang", "term"))
    return exact.withColumn("_docs", in_docs).filter((F.col("_docs") >= least) & F.col("source").isNotNull()).drop("_docs")


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)), as whole numbers of any size."""
    big = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    quotient = F.call_function("div", big, (total + 2 * v).cast("decimal(20,0)"))
    return 1 + quotient


def f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least: int = MIN_DOCS, top: int = TOP, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """lang, source, part, item, value, rank: every other source (``pair``), and the ``top`` terms (``term``)."""
    counts = materialize(kept_counts(docs, least, width, depth), "counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total_lang"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    groups = _texts(docs.select("lang", "source", F.lit(None).cast("string").alias("text"))).select("lang", "source").distinct()
    none = F.lit(0).cast("long")
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "terms", "v", "total_lang")])
    groups = materialize(groups.withColumn("p0", F.when(F.col("v") > 0, share(none, F.col("total"), F.col("v"))).otherwise(none)), "groups")
    few = groups.count() <= MAX_BROADCAST_SOURCES
    small = F.broadcast if few else (lambda x: x)

    shares = counts.join(small(groups), ["lang", "source"])
    shares = shares.select("lang", "source", "term", "v", "total_lang", "p0", share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    shares = materialize(shares, "shares")

    # term part: the language's own share of each term
    whole = shares.select("lang", "source", "term", "p", "v", "total_lang").join(vocabulary, ["lang", "term"])
    whole = whole.withColumn("q", share(F.col("n"), F.col("total_lang"), F.col("v"))).filter("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = whole.select("lang", "source", F.col("term").alias("item"), f(F.col("p"), F.col("q")).alias("value"))
    by_term = by_term.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    # pair part: each source's terms against the other's p0, by distinct share
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("terms_q"))
    against = groups.select("lang", "source", "v", "p0", "terms").join(small(other), "lang").filter("source <> item")
    levels = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    alone = levels.join(small(other), "lang").filter("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * f(F.col("p"), F.col("q0"))).alias("alone"))
    # terms of both: what the sums above have wrong there
    a = shares.select("lang", "term", F.col("source").alias("a"), "p", "p0")
    b = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    both = a.join(b, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).alias("both"))
    # of each pair one row: alone from either side, both once
    sides = alone.groupBy("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")).agg(F.sum("alone").alias("alone"))
    pair = against.filter("source < item").withColumnsRenamed({"source": "a", "item": "b"})
    pair = pair.join(sides, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    absent = F.when(F.col("v") > 0, (F.col("v") - F.col("terms") - F.col("terms_q")) * f(p0, q0)).otherwise(none)
    pair = pair.select("lang", "a", "b", (absent + F.coalesce("alone", none) + F.coalesce("both", none)).alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = pair.select("lang", ends.alias("e"), "value").select("lang", "e.source", "e.item", "value").withColumn("rank", F.row_number().over(best))

    parts = [d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, d in (("pair", pair), ("term", by_term))]
    return parts[0].unionByName(parts[1])


def divergence_query(docs: DataFrame) -> DataFrame:
    return divergence(docs.select("lang", "source", "text"))
