"""Benchmark decontamination: a broadcast set of test n-grams, scanned natively.

Every benchmark item is cut into windows of ``n`` words (a shorter item is one window).
Each window is filed under two neighbouring words of it, the longest such pair (ties: the
smallest), which is its anchor. Scanning a corpus then is: explode the word pairs of each
text, look each up in the broadcast hash set of anchors, and keep only the few positions
that match. For those the whole window is compared with the text word by word, so a hit
is never a hash collision.

The broadcast is sent only while the windows, with their words and item ids, take at most
``MAX_BROADCAST_BYTES``; beyond that the same join runs as a shuffled join. Only text with a
looked-up position is shuffled. All of it is DataFrame and SQL functions: no Python runs on
the executors.

Edge cases: null and empty texts have no words and no hits; null or wordless items have
no window; equal items count as separate items; documents are grouped by ``doc_id``, and
rows that share one (also null) are each judged on their own text; extra columns are kept
by ``remove_documents`` and ``remove_spans``, whose own columns are dropped again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, only_ids

N = 13
#: Words, anchors and item ids of the windows that are broadcast, at most.
MAX_BROADCAST_BYTES = 40_000_000


def norm_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    parts = F.array_remove(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def benchmark_windows(bench: DataFrame, n: int = N) -> DataFrame:
    """anchor, off (where it is in the window), win array<string>, items array<string>."""
    w = bench.select(F.col("item_id").cast("string").alias("item"), norm_words(F.col("text")).alias("w"))
    w = w.filter(F.size("w") > 0).select(
        "item",
        F.explode(
            F.expr(f"transform(sequence(0, greatest(size(w) - {n}, 0)), i -> slice(w, i + 1, {n}))")
        ).alias("win"),
    )
    pairs = "transform(sequence(0, greatest(size(win) - 2, 0)), i -> array_join(slice(win, i + 1, 2), ' '))"
    best = F.expr(f"array_min(transform({pairs}, (x, i) -> struct(-length(x) as l, x as x, i as i)))")
    return (
        w.groupBy("win")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("_b", best)
        .select("win", "items", F.col("_b.x").alias("anchor"), F.col("_b.i").alias("off"))
    )


def find_hits(docs: DataFrame, bench: DataFrame, n: int = N, key: str = "doc_id") -> DataFrame:
    """One row per document row: ``key``, ``text``, ``w`` (its words), and verified
    ``hits`` array<struct<start,len,items>>."""
    windows = materialize(benchmark_windows(bench, n), "windows")
    size = windows.agg(F.sum(F.octet_length(F.concat_ws(" ", "anchor", "win", "items")) + 8 * (F.size("win") + F.size("items")))).first()[0]
    small = (size or 0) <= MAX_BROADCAST_BYTES
    by_anchor = windows.groupBy("anchor").agg(F.collect_list(F.struct("off", "win", "items")).alias("cands"))
    by_anchor = F.broadcast(by_anchor) if small else by_anchor
    words = docs.select(key, norm_words(F.col("text")).alias("w"))
    pairs = words.select(key, F.posexplode(F.arrays_zip("w", F.expr("slice(w, 2, size(w))").alias("next"))).alias("pos", "p"))
    tokens = pairs.select(key, "pos", F.concat_ws(" ", "p.w", "p.next").alias("anchor")).filter("p.next is not null")
    if windows.filter("size(win) = 1").head(1):
        tokens = tokens.unionByName(words.select(key, F.posexplode("w").alias("pos", "anchor")))
    found = tokens.join(by_anchor, "anchor").select(key, "pos", F.explode("cands").alias("c"))
    # keys only here: what a document may contain is compared with its own words below
    found = found.filter("pos >= c.off").select(
        F.col(key).alias("_key"), (F.col("pos") - F.col("c.off")).alias("start"), "c.win", "c.items"
    )
    cands = found.groupBy("_key").agg(F.collect_set(F.struct("start", "win", "items")).alias("cands"))
    cands = materialize(cands, "candidates")
    # null keys find no partner in ``only_ids``: their rows all count as touched
    ids, named, unnamed = cands.select(F.col("_key").alias(key)).filter(F.col(key).isNotNull()), docs.filter(F.col(key).isNotNull()), docs.filter(F.col(key).isNull())
    touched = only_ids(named, ids, key).unionByName(unnamed)
    touched = touched.join(cands, touched[key].eqNullSafe(F.col("_key")), "left").drop("_key")
    rest = only_ids(named, ids, key, without=True).withColumn("cands", F.lit(None).cast(cands.schema["cands"].dataType))
    out = touched.unionByName(rest).withColumn("w", norm_words(F.col("text")))
    hits = F.expr(
        "transform(filter(cands, c -> slice(w, c.start + 1, size(c.win)) = c.win), "
        "c -> struct(c.start as start, size(c.win) as len, c.items as items))"
    )
    empty = F.array().cast("array<struct<start:int,len:int,items:array<string>>>")
    return out.withColumn("hits", F.coalesce(hits, empty)).drop("cands")


def judge(found: DataFrame) -> DataFrame:
    """Add n_words, hit (sorted hit word positions), n_hit, items, contaminated."""
    found = found.withColumn(
        "hit",
        F.array_sort(
            F.array_distinct(F.flatten(F.expr("transform(hits, h -> sequence(h.start, h.start + h.len - 1))")))
        ),
    ).withColumn("items", F.array_sort(F.array_distinct(F.flatten(F.expr("transform(hits, h -> h.items)")))))
    return found.withColumns(
        {"n_words": F.size("w").cast("long"), "n_hit": F.size("hit").cast("long")}
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate_query(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return judge(find_hits(docs.select("doc_id", "text"), bench)).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def _judged(docs: DataFrame, bench: DataFrame, n: int) -> DataFrame:
    """``docs`` under one struct column, so that no name can clash, with the judgement."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    rows = rows.select("_row", F.col("_row.doc_id").alias("_id"), F.col("_row.text").alias("text"))
    return judge(find_hits(rows, bench, n, key="_id"))


def remove_documents(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """``docs`` without the contaminated documents."""
    out = _judged(docs, bench, n)
    # not a filter: it would be pushed below the judgement, with all of it written out in it
    return out.select(F.explode(F.when(~F.col("contaminated"), F.array("_row"))).alias("_row")).select("_row.*")


def remove_spans(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with the hit words cut from ``text``; documents without a hit stay as they are.

    Where words go, the text becomes its remaining normalised words, one space between.
    """
    j = _judged(docs, bench, n)
    rest = F.array_join(F.array_compact(F.expr("transform(w, (x, i) -> if(array_contains(hit, i), null, x))")), " ")
    new = F.when(F.col("n_hit") > 0, rest).otherwise(F.col("text"))
    return j.select(*[new.alias(c) if c == "text" else F.col(f"_row.{c}") for c in docs.columns])
