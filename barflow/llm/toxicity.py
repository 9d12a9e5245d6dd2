"""Toxicity by compression distance.

A window is ``WINDOW`` words; windows overlap, and the last one ends the text. Two zstandard
dictionaries are trained, one on toxic and one on ordinary text, and a window's distance is
its compressed length under the ordinary dictionary less that under the toxic one. How many
windows of a document reach each of several calibrated thresholds goes into a logistic
regression.

Training. The ordinary dictionary is what zstandard's trainer makes of ordinary windows. The
toxic one shares that as its first part, so that common language costs the same under
either and a difference comes from the toxic part alone. For that part the trainer runs on
the toxic windows that the ordinary dictionary compresses worst; the stretches it returns
are then tested, each as an addition to the ordinary dictionary: kept is what shortens toxic
windows by ``SAVED`` bytes or more at ``LIFT`` times the rate of ordinary ones. (Trained on
all windows of a class at once, both dictionaries held the common words of the language: area
under the curve 0.6 on held-out documents.)

The fit sees at most ``PER_CLASS`` labelled documents of each class, never held-out ones, and
of their windows at most ``WINDOWS`` of each class, those least by a hash. The tests of the
stretches run as a Spark job, as does the scoring.

A run of more than ``LONG`` bytes without white space (text in a script without spaces, words
joined by other signs) is cut into overlapping windows of ``STRETCH`` bytes, at character
bounds, so every part of it is compared.

Edge cases: null and empty texts have no window and get the score of no hits; texts are
never cut short; with one class missing in the labels every score is 0; rows are independent,
so repeated rows and ``doc_id``s score alike; an input column named score or toxic_windows is
replaced, other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .fitting import PER_CLASS, held_out, labelled_sample, logistic, sigmoid

WINDOW, STRIDE = 3, 2
LONG, STRETCH = 64, 32
LEVEL = 3
#: Windows of each class that dictionaries are trained on, at most.
WINDOWS = 60_000
SHARED_BYTES = 28_672
#: Trainings of the toxic part: percentile of ordinary windows' cost from which on toxic ones are taken, bytes, segment and d-mer sizes.
TRAININGS = ((80, 4096, 10, 8), (80, 2048, 16, 8), (80, 4096, 12, 6), (90, 2048, 16, 6))
#: Stretches of what they return: their length, and how far they lie apart.
LENGTH, APART = 12, 4
#: Rounds of training, each on what the part so far compresses badly.
ROUNDS = 2
#: A stretch is kept if it saves so many bytes in toxic windows so many times as often as in ordinary ones, and so many times at least.
SAVED, LIFT, SUPPORT = 3, 4.0, 5
#: Windows of each class in the first and in the second test of a stretch.
SCREEN, TEST = 6000, 20_000
THRESHOLDS = (1, 2, 3, 4, 5, 6)


def windows(text: str) -> list[bytes]:
    """The windows of a text."""
    words, out, run = text.lower().encode().split(), [], []
    for w in words:
        if len(w) <= LONG:
            run.append(w)
            continue
        out += _of_words(run)
        out += _of_stretches(w)
        run = []
    return out + _of_words(run)


def _of_words(w: list[bytes]) -> list[bytes]:
    if not w:
        return []
    return [b" " + b" ".join(w[i : i + WINDOW]) + b" " for i in range(0, max(len(w) - WINDOW + STRIDE, 1), STRIDE)]


def _of_stretches(run: bytes) -> list[bytes]:
    starts = np.flatnonzero((np.frombuffer(run, np.uint8) & 0xC0) != 0x80)
    bounds = np.append(starts, len(run))
    at = bounds[np.searchsorted(bounds, np.arange(0, max(len(run) - STRETCH // 2, 1), STRETCH // 2))]
    ends = bounds[np.minimum(np.searchsorted(bounds, at + STRETCH), len(bounds) - 1)]
    return [run[a:b] for a, b in zip(at.tolist(), ends.tolist())]


def compressor(content: bytes):
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)


def lengths(c, of: list[bytes]) -> np.ndarray:
    """Compressed lengths."""
    f = c.compress
    return np.fromiter((len(f(w)) for w in of), np.int64, len(of))


def trained(samples: list[bytes], size: int, **how) -> bytes:
    """What zstandard's trainer makes of the samples; the samples' own end where they are too few for it."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()[-(size - min(300, size // 4)) :]
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: np.ndarray | None = field(default=None)

    def features(self, hits: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.column_stack([np.log1p(hits), hits / np.maximum(n, 1)[:, None] * 10])

    def score(self, hits: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(hits))
        return sigmoid(self.features(hits, n) @ self.weights[:-1] + self.weights[-1])


def _sampled_windows(sample: DataFrame) -> list[list[bytes]]:
    """Different windows of the ordinary and of the toxic documents, at most ``WINDOWS`` each."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for text, y in zip(df["text"], df["y"]):
                yield pd.DataFrame({"w": pd.Series(list(dict.fromkeys(windows(text))), dtype=object), "y": y})

    rows = sample.mapInPandas(emit, "w binary, y int").distinct()
    return [[bytes(r["w"]) for r in rows.filter(F.col("y") == v).orderBy(F.xxhash64("w"), "w").limit(WINDOWS).select("w").collect()] for v in (0, 1)]


def _rates(spark: SparkSession, stretches: list[bytes], shared: bytes, own: list[bytes], other: list[bytes]) -> pd.DataFrame:
    """Of each stretch: how many windows of its class and of the other it shortens by ``SAVED`` bytes."""
    c = compressor(shared)
    sent = spark.sparkContext.broadcast((shared, [(w, lengths(c, w)) for w in (own, other)]))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, sides = sent.value
        for df in batches:
            rows = []
            for s in df["s"]:
                c = compressor(base + s)
                rows.append((s, *(int((before - lengths(c, w) >= SAVED).sum()) for w, before in sides)))
            yield pd.DataFrame(rows, columns=["s", "own", "other"])

    parts = max(1, min(len(stretches), 4 * spark.sparkContext.defaultParallelism))
    table = spark.createDataFrame(pd.DataFrame({"s": stretches}), "s binary").repartition(parts)
    return table.mapInPandas(test, "s binary, own long, other long").toPandas()  # a row a stretch


def _lifts(t: pd.DataFrame, own: list[bytes], other: list[bytes]) -> pd.Series:
    return (t["own"] / max(len(own), 1)) / ((t["other"] + 2) / max(len(other), 1))


def own_part(spark: SparkSession, shared: bytes, own: list[bytes], other: list[bytes]) -> bytes:
    """The stretches that tell ``own`` windows from ``other`` ones: the best last, nearest to what is compressed."""
    rnd, part = np.random.default_rng(0), b""
    some = lambda ws, n: [ws[i] for i in rnd.permutation(len(ws))[:n]]
    for _ in range(ROUNDS):
        c = compressor(shared + part)
        dear = [lengths(c, w) - np.array([len(x) for x in w]) / 2 for w in (own, other)]
        limits = {q: np.percentile(dear[1], q) for q, *_ in TRAININGS}
        found: dict[bytes, None] = {}
        for q, size, k, d in TRAININGS:
            content = trained([w for w, x in zip(own, dear[0]) if x >= limits[q]], size, k=k, d=d)
            found |= dict.fromkeys(content[i : i + LENGTH] for i in range(0, max(len(content) - LENGTH + 1, 1), APART))
        stretches, least = [s for s in found if s], min(limits.values())
        hard = [[w for w, x in zip(ws, xs) if x >= least] for ws, xs in zip((own, other), dear)]
        for sides, n, lift, support in ((hard, SCREEN, LIFT / 2, 2), ((own, other), TEST, LIFT, SUPPORT)):
            if not stretches:
                return part
            a, b = (some(w, n) for w in sides)
            t = _rates(spark, stretches, shared + part, a, b)
            t["lift"] = _lifts(t, a, b)
            t = t[(t["lift"] >= lift) & (t["own"] >= support)].sort_values(["lift", "s"])
            stretches = [bytes(s) for s in t["s"]]
        part = b"".join(stretches) + part
    return part


def fit(docs: DataFrame, labels: DataFrame, mod: int, rest: int, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Dictionaries from the sample's windows, then thresholds' weights from its documents."""
    spark = docs.sparkSession
    sample = materialize(labelled_sample(docs, labels, label, mod, rest, per_class), "sample")
    ordinary, toxic = _sampled_windows(sample)
    if not toxic or not ordinary:
        return Model()
    shared = trained(ordinary, SHARED_BYTES)
    model = Model(shared + own_part(spark, shared, toxic, ordinary), shared)
    seen = _counts(sample, model).select("y", "n", "hits").toPandas()  # at most 2 * per_class rows
    model.weights = logistic(model.features(np.array(seen["hits"].tolist()), seen["n"].to_numpy()), seen["y"].to_numpy())
    return model


def _counts(df: DataFrame, model: Model) -> DataFrame:
    """``df`` with n (windows) and hits (array: windows at or above each threshold)."""
    toxic, ordinary, levels = model.toxic, model.ordinary, np.array(THRESHOLDS)

    @F.pandas_udf("n long, hits array<long>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by = compressor(ordinary), compressor(toxic)
        for s in batches:
            n, hits = [], []
            for t in s:
                w = windows(t or "")
                apart = lengths(by[0], w) - lengths(by[1], w)
                n.append(len(w))
                hits.append((apart[:, None] >= levels).sum(axis=0).tolist())
            yield pd.DataFrame({"n": n, "hits": hits})

    return df.withColumn("_c", count(F.col("text"))).select(*df.columns, "_c.n", "_c.hits")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (double, 0 to 1) and toxic_windows (those that the toxic dictionary shortens by ``SAVED`` bytes)."""
    kept = [c for c in docs.columns if c not in ("score", "toxic_windows")]
    c = _counts(docs.select(F.struct(*kept).alias("row"), "text"), model)

    @F.pandas_udf("double")
    def score(hits: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(hits.tolist()).reshape(-1, len(THRESHOLDS)), n.to_numpy()))

    return c.select("row.*", score("hits", "n").alias("score"), F.col("hits")[THRESHOLDS.index(SAVED)].alias("toxic_windows"))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, mod=3, rest=1)
    out = score_documents(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "toxic_windows"
    )
