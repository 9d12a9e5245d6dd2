"""Mixing sources to target weights: random order by hash, prefix sums, exact cuts.

1. sizes: each document's words are counted, once; from here on rows are narrow (no text).
2. targets: sources in the order of their names have the weights of ``WEIGHTS`` in turn and
   share ``SHARE`` of all words. A target stops at ``EPOCHS`` times its source's size, and
   what is left over is shared again by weight. The end of that resharing is a level: each
   target is the smaller of its limit and level * weight. With the sources sorted by limit
   over weight, the level is the largest of (words left) / (weights left) at each source,
   so two prefix sums and a maximum give it, however many sources there are.
3. order: a document's random key is a hash of a seed, its id and its text. Rows are sorted
   by range of (source, key), and prefix sums say how many words of its source come before.
4. cut: a source is taken whole as often as its budget (the target without its fraction)
   holds it; in the last epoch words are taken in the order of the keys until the budget is
   used up exactly, so the last document of it is cut to its first words.

All of it is DataFrame and SQL functions. One source may hold any share of the rows: it is
spread over partitions by its keys (``prefix``).

Edge cases: null text has no words and is never taken; a null source is a source, the last one;
a source without words has the target 0; rows equal in id and text are told apart by their
place in the table, and since they are equal it does not matter which of them is cut; an
empty table gives no rows; extra columns are kept by ``mix_documents``, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, words
from .prefix import prefix_sums

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
EPOCHS = 2
SEED = 0
#: Rows of targets that are broadcast, at most; beyond that they are joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000


def _sized(rows: DataFrame, seed: int) -> DataFrame:
    """_uid, doc_id, source, size, _key of rows that have doc_id, text, source, _uid."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), digest).cast("binary"))
    return rows.select("_uid", "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("_key"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target of a table with one row a source (source, source_size).

    ``weights`` are whole numbers; source i in the order of names (null last) has ``weights[i % len]``.
    """
    s = materialize(sizes.select("source", "source_size", F.col("source").isNull().alias("_last"), F.lit(1).alias("_one")), "sources")
    ranked = prefix_sums(s, [], ["_last", "source"], {"_rank": "_one"})
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    limit = F.col("source_size") * epochs
    ranked = ranked.withColumns({"_w": w, "_limit": limit}).withColumn("_level", F.col("_limit") * F.expr(f"{lcm(*weights)} div _w"))
    ranked = materialize(ranked, "weighted")
    filled = prefix_sums(ranked, [], ["_level", "_last", "source"], {"_full": "_limit", "_gone": "_w"})
    size, weight = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    left = F.lit(size).cast("long") * share.numerator - F.col("_full") * share.denominator
    level = filled.agg(F.max(left / ((F.lit(weight).cast("long") - F.col("_gone")) * share.denominator))).first()[0]
    reach = F.lit(level).cast("double") * F.col("_w")
    return ranked.select("source", "source_size", F.least(F.col("_limit").cast("double"), reach).alias("target"))


def _taken(sized: DataFrame, weights, share: Fraction, epochs: int) -> DataFrame:
    """_uid, doc_id, source, size, source_size, target, taken of a stored table of ``_sized``."""
    goals = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs), "targets")
    goals = goals.withColumnRenamed("source", "_source")
    placed = prefix_sums(sized, ["source"], ["_key", "_uid"], {"_before": "size"})
    few = goals.count() <= MAX_BROADCAST_SOURCES
    j = placed.join(F.broadcast(goals) if few else goals, F.col("source").eqNullSafe(F.col("_source")))
    budget = F.floor("target").cast("long")
    whole = F.coalesce(F.expr("cast(floor(target) as bigint) div nullif(source_size, 0)"), F.lit(0).cast("long"))
    rest = budget - whole * F.col("source_size")
    last = F.greatest(F.least(rest - F.col("_before"), F.col("size")), F.lit(0).cast("long"))
    return j.select("_uid", "doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + last).alias("taken"))


def mixing_query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    rows = docs.select("doc_id", "text", "source").withColumn("_uid", F.monotonically_increasing_id())
    return _taken(materialize(_sized(rows, SEED), "sized"), WEIGHTS, SHARE, EPOCHS).drop("_uid", "source")


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as the mix takes it.

    A document that the budget ends in comes once with its first words only, one space between.
    """
    stored = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("_uid")), "rows")
    sized = materialize(_sized(stored.select("row.doc_id", "row.text", "row.source", "_uid"), seed), "sized")
    used = _taken(sized, weights, share, epochs).select("_uid", "size", "taken").filter("taken > 0")
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size"))), lambda i: F.least("size", F.col("taken") - (i - 1) * F.col("size")))
    out = stored.join(used, "_uid").select("row", "size", F.explode(copies).alias("_n"))
    cut = F.array_join(F.slice(words(F.col("row.text")), F.lit(1), F.col("_n").cast("int")), " ")
    text = F.when(F.col("_n") < F.col("size"), cut).otherwise(F.col("row.text"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
