"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad given its own features and those of the lines before
and after it. The forward-backward pass gives each line its marginal; a document's quality
is the mean marginal weighted by line length, calibrated to a probability.

Lines carry no labels of their own, so the chain is fitted with each line taking its
document's label (up to ``PER_CLASS`` documents a class, never held-out ones, and of each up
to ``STRETCHES`` stretches of ``STRETCH`` lines), by gradient ascent on the conditional likelihood.

Features come from one pass over the bytes of many texts at once, as does the recursion:
step t handles the t-th line of every document that has one.

Edge cases: null texts and texts without a non-empty line have score 0; texts are never
cut in scoring; rows are independent, so repeated rows and ``doc_id``s score alike; with one
class missing in the labels every score is 0; an input column named score is replaced, other
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .fitting import PER_CLASS, held_out, labelled_sample, logistic, sigmoid
from .pretokens import chunks

#: The fit sees at most so many stretches of so many lines of each sampled document, evenly spread.
STRETCHES, STRETCH = 4, 40
STEPS, RATE, RIDGE = 150, 0.1, 1e-3

_CLASS = np.zeros(256, np.uint8)  # bits: 1 white space, 2 symbol, 4 upper case, 8 digit, 16 stop, 32 letter
for _bytes, _bit in ((b" \t\r\x0b\x0c", 1), (b"#*$%&|<>", 2), (bytes(range(65, 91)), 4), (b"0123456789", 8), (b".,;:!?", 16)):
    _CLASS[np.frombuffer(_bytes, np.uint8)] |= _bit
_CLASS[65:91] |= 32
_CLASS[97:123] |= 32
_CLASS[0xC0:] |= 32  # first byte of a longer UTF-8 character
BASE = 12


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every non-empty line (with its neighbours'), line lengths, lines per text."""
    lines = [[x for x in t.encode().split(b"\n") if x] for t in texts]
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = [x for ls in lines for x in ls]
    if not flat:
        return np.zeros((0, 3 * BASE + 1), np.float32), np.zeros(0), counts
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    at = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(flat), np.uint8)
    kind = _CLASS[raw]

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, at, dtype=np.int64).astype(np.float32)

    space = kind & 1
    begins = space == 0
    begins[1:] &= space[:-1] == 1
    begins[at] = space[at] == 0
    words = np.maximum(per_line(begins), 1)
    chars = np.maximum(size - per_line(space), 1).astype(np.float32)
    letters = np.maximum(per_line(kind & 32 != 0), 1)
    split = [x.split() for x in flat]
    # neighbours that are one word, and words that are not new in their line
    stutter = np.fromiter((sum(map(eq, w, w[1:])) for w in split), np.float32, len(flat)) / words
    old = np.fromiter((len(w) - len(set(w)) for w in split), np.float32, len(flat)) / words
    again = np.fromiter((y for ls in lines for y in _seen(ls)), np.float32, len(flat))
    base = np.column_stack([
        np.minimum(np.log1p(words), 5) / 3,
        np.minimum(chars / words, 30) / 10,
        np.minimum(per_line(kind & 2 != 0) / words, 4) / 2,
        np.minimum(per_line(kind & 4 != 0) / letters, 1),
        np.minimum(per_line(kind & 8 != 0) / chars, 1),
        np.minimum(per_line(kind & 16 != 0) / words, 3),
        np.minimum(per_line(raw == 0x21) / words, 2),
        np.minimum(per_line(raw == 0x7C) / words, 2),
        again,
        (words < 4).astype(np.float32),
        stutter,
        old * (words > 8),
    ]).astype(np.float32)
    before, after = np.zeros_like(base), np.zeros_like(base)
    doc = np.repeat(np.arange(len(lines)), counts)
    same = doc[1:] == doc[:-1]
    before[1:][same] = base[:-1][same]
    after[:-1][same] = base[1:][same]
    return np.column_stack([base, before, after, np.ones(len(flat), np.float32)]), size, counts


def _seen(lines: list[bytes]) -> Iterator[bool]:
    before: set = set()
    for x in lines:
        yield x in before
        before.add(x)


class Chains:
    """Sequences of different lengths side by side: step t holds those longer than t."""

    def __init__(self, counts: np.ndarray):
        self.order = np.argsort(-counts, kind="stable")
        sizes, starts = counts[self.order], (np.cumsum(counts) - counts)[self.order]
        longest = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than t
        self.at = [starts[:k] + t for t, k in enumerate(alive)]


def forward_backward(emit: np.ndarray, trans: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of 'good' per line, expected transition counts (2 x 2), total log partition."""
    n = len(emit)
    alpha, beta, logz = np.zeros((n, 2)), np.zeros((n, 2)), 0.0
    pairs = np.zeros((2, 2))
    at = chains.at
    for t, i in enumerate(at):
        if t == 0:
            alpha[i] = emit[i]
        else:
            a = alpha[at[t - 1][: len(i)]]
            alpha[i] = emit[i] + np.logaddexp(a[:, :1] + trans[0], a[:, 1:] + trans[1])
    for t in range(len(at) - 2, -1, -1):
        i, j = at[t], at[t + 1]
        e = emit[j] + beta[j]
        beta[i[: len(j)]] = np.logaddexp(trans[:, 0] + e[:, :1], trans[:, 1] + e[:, 1:])
        joint = alpha[i[: len(j)], :, None] + trans + e[:, None, :]
        z = np.logaddexp.reduce(joint.reshape(len(j), 4), axis=1)
        pairs += np.exp(joint - z[:, None, None]).sum(axis=0)
    both = alpha + beta
    if len(at):
        logz = float(np.logaddexp(both[at[0], 0], both[at[0], 1]).sum())
    return sigmoid(both[:, 1] - both[:, 0]), pairs, logz


@dataclass
class Model:
    weights: np.ndarray  # of 'good' against 'bad', one for each feature
    trans: np.ndarray
    calibration: np.ndarray | None

    def document_means(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean marginal of each text (NaN without lines), as log odds."""
        x, size, counts = line_features(texts)
        out = np.full(len(texts), np.nan)
        if len(x):
            emit = np.column_stack([np.zeros(len(x)), x @ self.weights])
            good, _, _ = forward_backward(emit, self.trans, Chains(counts))
            has = counts > 0
            at = (np.cumsum(counts) - counts)[has]
            m = np.add.reduceat(good * size, at) / np.add.reduceat(size, at)
            m = np.clip(m, 1e-4, 1 - 1e-4)
            out[has] = np.log(m / (1 - m))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.calibration is None:
            return np.zeros(len(texts))
        m = self.document_means(texts)
        return np.where(np.isnan(m), 0.0, sigmoid(np.nan_to_num(m) * self.calibration[0] + self.calibration[1]))


def fit(docs: DataFrame, labels: DataFrame, mod: int, rest: int, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on a labelled sample; features are computed in Spark, the driver gets numbers only."""
    sample = materialize(labelled_sample(docs, labels, label, mod, rest, per_class), "sample")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for text, y in zip(df["text"], df["y"]):
                x, _, _ = line_features([text])
                starts = np.arange(0, len(x), STRETCH)
                starts = starts[np.unique(np.linspace(0, len(starts) - 1, STRETCHES).astype(int))] if len(starts) else starts
                cut = [x[s : s + STRETCH] for s in starts.tolist()]
                yield pd.DataFrame({"y": int(y), "n": [len(c) for c in cut], "x": [c.tobytes() for c in cut]})

    got = sample.mapInPandas(features, "y int, n long, x binary").toPandas()  # at most 2 * per_class * STRETCHES rows of 6 KB
    wide = 3 * BASE + 1
    if got["y"].nunique() < 2:
        return Model(np.zeros(wide), np.zeros((2, 2)), None)
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, wide) for b in got["x"]]).astype(np.float64)
    n, y = got["n"].to_numpy(), got["y"].to_numpy()
    chains, state = Chains(n), np.repeat(y, n)
    w, trans = np.zeros(wide), np.zeros((2, 2))
    bad_bad, good_good = (float((n[y == s] - 1).sum()) for s in (0, 1))
    seen = np.array([[bad_bad, 0.0], [0.0, good_good]])
    grad_sum = np.full(wide, 1e-8)
    for _ in range(STEPS):
        good, pairs, _ = forward_backward(np.column_stack([np.zeros(len(x)), x @ w]), trans, chains)
        g = x.T @ (state - good) / len(x) - RIDGE * w
        grad_sum += g * g
        w += RATE * g / np.sqrt(grad_sum) * 3
        trans += RATE * np.clip((seen - pairs) / len(x) - RIDGE * trans, -1, 1)
    model = Model(w, trans, None)

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"y": df["y"], "m": model.document_means(df["text"].tolist())})

    m = sample.mapInPandas(means, "y int, m double").filter("m is not null and not isnan(m)").toPandas()  # a row a document
    if m["y"].nunique() < 2:
        return model
    model.calibration = logistic(m[["m"]].to_numpy(), m["y"].to_numpy())
    # the sample is balanced, the labels are not
    share = labels.filter(~held_out(mod, rest) & F.col(label).isin(0, 1)).groupBy(F.col(label).alias("y")).count().collect()  # two rows
    share = {r["y"]: r["count"] for r in share}
    model.calibration[1] += np.log(share[1] / share[0])
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (double, 0 to 1); an input column of that name is replaced, others are kept."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("").tolist()
        return pd.Series(np.concatenate([np.zeros(0)] + [model.score(texts[a:b]) for a, b in chunks(texts)]))

    return docs.withColumn("score", score("text"))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, mod=4, rest=2)
    out = score_documents(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
