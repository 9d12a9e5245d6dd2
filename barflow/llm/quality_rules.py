"""Quality rules: a threshold table compiled into one projection of built-ins.

``RULES`` is plain data: a rule fails a document when its measure is outside
[low, high]. ``compile_rules`` turns the table into one array expression of failed
rule names, so adding a rule adds neither a stage nor a function call per row.
No Python runs on the executors.

Edge cases: null and empty texts have no words, so they fail ``min_words`` and are
not kept; repeated rows are judged each on their own; extra columns pass through
``apply_rules`` unless they have the name of an output column, which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, words

SYMBOLS = "#*$%&|<>"

#: The most frequent function words of four languages.
STOP_WORDS = (
    "the of and to in a is that it was for on are as with be this "
    "le la les de des du et un une que qui dans pour est en "
    "el los las del y con por para una se su al "
    "der die das und den von zu mit ist ein eine nicht sich auf"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str  # SQL over the measured columns
    low: float | None = None
    high: float | None = None
    base: bool = False


#: The threshold table. Base rules come first; the others refine the verdict.
RULES = (
    Rule("min_words", "n_words", low=50, base=True),
    Rule("repeated_words", "100 * n_repeat_words - 50 * n_words", high=0, base=True),
    Rule("word_length", "word_chars / greatest(n_words, 1)", low=1.5, high=25),
    Rule("symbol_ratio", "n_symbols / greatest(n_words, 1)", high=0.5),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", high=0.5),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", low=0.01),
    Rule("upper_case", "n_upper / greatest(word_chars, 1)", high=0.5),
)

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_stop_words", "n_upper",
)


def _removed(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measures the rules need; each stage below is one projection.

    A three-word window is compared by a 64-bit hash. Most texts have few windows that
    repeat, and are finished by looking each window up in that short list; texts with
    many sort (hash, position) pairs instead, so the cost stays n log n.
    """
    keep = [c for c in df.columns if c not in MEASURES]
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.select(
        *keep,
        words(text).alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: F.length(_removed(x, " " + WHITE)) > 0).alias("_lines"),
        F.length(_removed(text, " " + WHITE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_removed(text, SYMBOLS))).cast("long").alias("n_symbols"),
        # letters that a lower-casing changes, without building the difference per letter
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
    )
    out = out.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.expr(
            "if(size(_w) < 3, cast(array() as array<bigint>), "
            "transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))"
        ).alias("_h"),
    ).drop("_lines", "_w")
    out = out.withColumn("_s", F.sort_array("_h"))
    out = out.withColumn(
        "_d", F.expr("array_distinct(filter(_s, (x, i) -> i > 0 and x = _s[greatest(i - 1, 0)]))")
    ).drop("_s")
    few = F.expr("filter(transform(_h, (x, i) -> if(array_contains(_d, x), i, -1)), i -> i >= 0)")
    out = out.withColumn(
        "_z",
        F.when((F.size("_d") > 24), F.expr("array_sort(transform(_h, (x, i) -> struct(x as h, i as p)))")),
    )
    many = F.expr(
        "transform(filter(_z, (x, i) -> (i > 0 and x.h = _z[greatest(i - 1, 0)].h) or "
        "(i < size(_z) - 1 and x.h = _z[least(i + 1, size(_z) - 1)].h)), x -> x.p)"
    )
    out = out.withColumn(
        "_p",
        F.when(F.size("_d") == 0, F.array().cast("array<int>"))
        .when(F.col("_z").isNull(), few)
        .otherwise(many),
    ).drop("_h", "_d", "_z")
    repeat = F.size(F.array_distinct(F.flatten(F.transform("_p", lambda p: F.array(p, p + 1, p + 2)))))
    return out.withColumn("n_repeat_words", repeat.cast("long")).drop("_p")


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """array<string>: names of the rules that a measured row fails."""
    checks = []
    for r in rules:
        m, bad = F.expr(r.measure), F.lit(False)
        if r.low is not None:
            bad = bad | (m < r.low)
        if r.high is not None:
            bad = bad | (m > r.high)
        checks.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*checks))


def apply_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the measures, ``failed`` (names), ``base_failed`` and ``kept``."""
    base = [r.name for r in rules if r.base]
    out = measure(df.drop("failed", "base_failed", "kept"), text_col).withColumn("failed", compile_rules(rules))
    return out.withColumns(
        {
            "base_failed": F.arrays_overlap("failed", F.array(*map(F.lit, base))),
            "kept": F.size("failed") == 0,
        }
    )


def keep_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs``, its columns unchanged, without the documents that fail a rule."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    out = apply_rules(rows, "_text", rules)
    # not a filter: it would be pushed below the measures, with all of them written out in it
    return out.select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row")).select("_row.*")


def quality_rules_query(docs: DataFrame) -> DataFrame:
    return apply_rules(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
