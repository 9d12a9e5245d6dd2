"""Sobol sensitivity: samples, indices, groups, diagnostics, surfaces.

Rows carry their identity (base_id, block, j), never their position, so a missing result
drops its base group and shifts nothing. A problem is a small dict:
``{"parameters": [{"name", "bounds", "type", "category"}], "metrics": [...]}``.
"""

from __future__ import annotations

import json
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backtest import MODULUS, mixed
from .sequences import sobol_number

#: The closed sets a problem may use.
CATEGORIES = ("signal-structural", "signal-threshold", "execution")
TYPES = ("float", "int")


def load_problem(source: str | dict) -> dict:
    """Check a problem and fill in defaults; each fault has its own message."""
    if isinstance(source, str):
        with open(source) as f:
            source = json.load(f)
    for key in ("parameters", "metrics"):
        if not source.get(key):
            raise ValueError(f"problem has no {key}")
    out = []
    for p in source["parameters"]:
        for key in ("name", "bounds"):
            if key not in p:
                raise ValueError(f"parameter lacks {key}")
        b = p["bounds"]
        if len(b) != 2 or not b[0] < b[1]:
            raise ValueError(f"{p['name']}: bounds must be two numbers, the lower first")
        q = {"type": "float", "category": "signal-structural"} | p
        if q["type"] not in TYPES:
            raise ValueError(f"{p['name']}: unknown type {q['type']!r}")
        if q["category"] not in CATEGORIES:
            raise ValueError(f"{p['name']}: unknown category {q['category']!r}")
        out.append(q)
    return {**source, "parameters": out}


def _names(problem: dict) -> list[str]:
    return [p["name"] for p in problem["parameters"]]


def round_int_params(samples: DataFrame, problem: dict) -> DataFrame:
    """Integer parameters rounded half to even."""
    return samples.withColumns({p["name"]: F.rint(p["name"]) for p in problem["parameters"] if p["type"] == "int"})


def sample_plan(n_rows: DataFrame, problem: dict, n: int = 1024) -> DataFrame:
    """Rows and estimated seconds of a run (1 s a row, or eight at once) beside the input's size."""
    rows = n * (2 * len(problem["parameters"]) + 2)
    return n_rows.select(
        "*", F.lit(rows).cast("long").alias("sample_rows"), F.lit(float(rows)).alias("seconds"), F.lit(rows / 8).alias("seconds_by_8")
    )


def saltelli_samples(spark: SparkSession, problem: dict, n: int = 1024, seed: int = 0, sequence: str = "sobol") -> DataFrame:
    """sample_id, base_id, block (A, AB, BA, B), j, and one column for each parameter.

    A and B are the two halves of a point of Sobol's sequence (``sobol``), or of an arithmetic hash of
    (base_id, dimension) (``hash``). Either way a row follows from its base_id alone.
    """
    if sequence not in ("sobol", "hash"):
        raise ValueError(f"unknown sequence {sequence!r}")
    params = problem["parameters"]
    d = len(params)
    u = lambda k: F.expr(sobol_number("base_id", k, n, seed) if sequence == "sobol" else f"(({mixed('base_id', str(k + 2 * d * seed))}) + 0.5) / {MODULUS}")
    base = spark.range(n).withColumnRenamed("id", "base_id")
    base = base.withColumns({f"_u{k}": u(k) for k in range(2 * d)})
    blocks = [("A", None), *[(b, j) for b in ("AB", "BA") for j in range(d)], ("B", None)]
    tags = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("block"), F.lit(j).cast("int").alias("j")) for i, (b, j) in enumerate(blocks)])
    rows = base.withColumn("t", F.explode(tags))
    cols = []
    for k, p in enumerate(params):
        lo, hi = p["bounds"]
        mine = F.col("t.j") == k
        from_b = (F.col("t.block") == "B") | ((F.col("t.block") == "AB") & mine) | ((F.col("t.block") == "BA") & ~F.coalesce(mine, F.lit(False)))
        value = F.lit(float(lo)) + F.when(from_b, F.col(f"_u{d + k}")).otherwise(F.col(f"_u{k}")) * (hi - lo)
        cols.append((F.rint(value) if p["type"] == "int" else value).alias(p["name"]))
    sid = (F.col("base_id") * len(blocks) + F.col("t.i")).alias("sample_id")
    return rows.select(sid, "base_id", F.col("t.block").alias("block"), F.col("t.j").alias("j"), *cols)


def fill_nan_mean(results: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """NaN or null metrics become the mean of the others (of the same group, if given)."""
    by = by or []
    clean = results.withColumns({m: F.when(~F.isnan(m), F.col(m)) for m in metrics})
    means = clean.groupBy(*by).agg(*[F.avg(m).alias(f"_m_{m}") for m in metrics])
    joined = clean.join(means, by) if by else clean.crossJoin(F.broadcast(means))  # one row
    return joined.withColumns({m: F.coalesce(m, f"_m_{m}") for m in metrics}).drop(*[f"_m_{m}" for m in metrics])


def _wide(results: DataFrame, d: int, metric: str, by: list[str]) -> DataFrame:
    """One row for each complete base group: a, b, ab0.., ba0.."""
    pick = lambda b, j=None: F.max(F.when((F.col("block") == b) & (F.lit(True) if j is None else F.col("j") == j), F.col(metric)))
    cols = [pick("A").alias("a"), pick("B").alias("b"), *[pick("AB", j).alias(f"ab{j}") for j in range(d)], *[pick("BA", j).alias(f"ba{j}") for j in range(d)]]
    return results.groupBy(*by, "base_id").agg(*cols).na.drop()


def sobol_indices(results: DataFrame, problem: dict, metric: str, by: list[str] | None = None) -> DataFrame:
    """kind (S1, ST, S2), param, param2, value for each group of ``by``: plain averages.

    Estimators of Saltelli (2010) and Jansen over the standardised metric; null where it never varies.
    """
    by, names = by or [], _names(problem)
    d = len(names)
    w = _wide(results, d, metric, by)
    both = F.explode(F.array("a", "b")).alias("_y")
    scale = w.select(*by, both).groupBy(*by).agg(F.avg("_y").alias("_mu"), F.stddev_pop("_y").alias("_sd"))
    w = w.join(scale, by) if by else w.crossJoin(F.broadcast(scale))  # one row
    z = lambda c: F.try_divide(F.col(c) - F.col("_mu"), "_sd")
    s1 = lambda j: F.avg(z("b") * (z(f"ab{j}") - z("a")))
    st = lambda j: F.avg(F.pow(z("a") - z(f"ab{j}"), 2)) / 2
    s2 = lambda j, k: F.avg(z(f"ba{j}") * z(f"ab{k}") - z("a") * z("b")) - s1(j) - s1(k)
    row = lambda kind, p, q, v: F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("param"), F.lit(q).cast("string").alias("param2"), v.alias("value"))
    rows = [row("S1", names[j], None, s1(j)) for j in range(d)] + [row("ST", names[j], None, st(j)) for j in range(d)]
    rows += [row("S2", names[j], names[k], s2(j, k)) for j in range(d) for k in range(j + 1, d)]
    out = w.groupBy(*by).agg(F.array(*rows).alias("r"))
    return out.select(*by, F.explode("r").alias("r")).select(*by, "r.*")


def sobol_confidence(results: DataFrame, problem: dict, metric: str, by: list[str], n_boot: int = 100, seed: int = 0) -> DataFrame:
    """S1_conf, ST_conf of each parameter: 1.96 standard deviations over resampled base groups.

    A group is one metric's base rows, N x (2D + 2) doubles: the size of the design, not of the data.
    """
    names = _names(problem)
    d = len(names)
    w = _wide(results, d, metric, by)
    kinds = ", ".join(f"`{k}` {t}" for k, t in w.select(*by).dtypes)

    def boot(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[["a", "b", *[f"ab{j}" for j in range(d)]]].to_numpy()
        both = np.concatenate([y[:, 0], y[:, 1]])
        y = (y - both.mean()) / (both.std() or np.nan)
        rng = np.random.default_rng(seed)
        weight = rng.multinomial(len(y), np.full(len(y), 1 / len(y)), n_boot) / len(y)
        first = weight @ (y[:, 1:2] * (y[:, 2:] - y[:, :1]))
        total = weight @ ((y[:, :1] - y[:, 2:]) ** 2) / 2
        out = pd.DataFrame({"param": names, "s1_conf": 1.96 * first.std(0, ddof=1), "st_conf": 1.96 * total.std(0, ddof=1)})
        return out.assign(**{k: pdf[k].iloc[0] for k in by})[[*by, *out.columns]]

    return w.groupBy(*by).applyInPandas(boot, f"{kinds}, param string, s1_conf double, st_conf double")


def _categories(spark: SparkSession, problem: dict) -> DataFrame:
    rows = [(p["name"], p["category"], CATEGORIES.index(p["category"])) for p in problem["parameters"]]
    return F.broadcast(spark.createDataFrame(rows, "param string, category string, rank int"))  # one row a parameter


def group_indices(idx: DataFrame, problem: dict, by: list[str]) -> DataFrame:
    """Sum of S1 and of ST for every category (0 where it has no parameter)."""
    c = _categories(idx.sparkSession, problem)
    g = idx.join(c, "param").filter("kind in ('S1', 'ST')")
    aggs = []
    for i, cat in enumerate(CATEGORIES):
        for kind in ("S1", "ST"):
            aggs.append(F.coalesce(F.sum(F.when((F.col("category") == cat) & (F.col("kind") == kind), F.col("value"))), F.lit(0.0)).alias(f"{kind}_{i}"))
    rows = F.array(*[F.struct(F.lit(cat).alias("category"), F.col(f"S1_{i}").alias("s1"), F.col(f"ST_{i}").alias("st")) for i, cat in enumerate(CATEGORIES)])
    return g.groupBy(*by).agg(*aggs).select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def interaction_shares(idx: DataFrame, by: list[str]) -> DataFrame:
    """(ST - S1) / ST of each parameter, 0 where ST is at most 0.001."""
    w = idx.filter("kind in ('S1', 'ST')").groupBy(*by, "param").agg(
        F.max(F.when(F.col("kind") == "S1", F.col("value"))).alias("s1"), F.max(F.when(F.col("kind") == "ST", F.col("value"))).alias("st")
    )
    share = F.when(F.col("st") > 0.001, (F.col("st") - F.col("s1")) / F.nullif("st", F.lit(0.0))).otherwise(0.0)
    return w.select(*by, "param", share.alias("share"))


def cross_group(idx: DataFrame, problem: dict, by: list[str]) -> DataFrame:
    """Sum of S2 for each of the six category pairs."""
    c = _categories(idx.sparkSession, problem)
    s2 = idx.filter("kind = 'S2'").join(c.select("param", F.col("rank").alias("r1")), "param")
    s2 = s2.join(c.select(F.col("param").alias("param2"), F.col("rank").alias("r2")), "param2")
    lo, hi = F.least("r1", "r2"), F.greatest("r1", "r2")
    pairs = [(i, k) for i in range(3) for k in range(i, 3)]
    aggs = [F.coalesce(F.sum(F.when((lo == i) & (hi == k), F.col("value"))), F.lit(0.0)).alias(f"p{i}{k}") for i, k in pairs]
    rows = F.array(*[F.struct(F.lit(CATEGORIES[i]).alias("category1"), F.lit(CATEGORIES[k]).alias("category2"), F.col(f"p{i}{k}").alias("s2")) for i, k in pairs])
    return s2.groupBy(*by).agg(*aggs).select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def interaction_matrix(cross: DataFrame, by: list[str]) -> DataFrame:
    """The six pairs as a symmetric matrix: category and one column for each category."""
    swapped = cross.filter("category1 <> category2").select(*by, F.col("category2").alias("category1"), F.col("category1").alias("category2"), "s2")
    both = cross.unionByName(swapped)
    aggs = [F.sum(F.when(F.col("category2") == c, F.col("s2"))).alias(c.replace("-", "_")) for c in CATEGORIES]
    return both.groupBy(*by, F.col("category1").alias("category")).agg(*aggs)


def group_contributions(groups: DataFrame, by: list[str]) -> DataFrame:
    """S1 of each category and its percentage of the total (0 where the total is not positive)."""
    total = groups.groupBy(*by).agg(F.sum("s1").alias("_t"))
    pct = F.when(F.col("_t") > 0, 100 * F.col("s1") / F.nullif("_t", F.lit(0.0))).otherwise(0.0)
    return groups.join(total, by).select(*by, "category", "s1", pct.alias("percent"))


def params_at_bounds(results: DataFrame, problem: dict, metric: str, by: list[str], threshold: float = 0.05) -> DataFrame:
    """Of the top tenth by metric: parameters that crowd a bound (lower, upper or none)."""
    from pyspark.sql import Window

    r = results.filter(F.col(metric).isNotNull() & ~F.isnan(metric))
    n = results.groupBy(*by).agg(F.floor(F.count("*") * 0.1).alias("_k"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(metric), "sample_id"))
    top = r.withColumn("_r", rank).join(n, by).filter("_r <= _k")
    aggs = []
    for p in problem["parameters"]:
        lo, hi = p["bounds"]
        near = threshold * (hi - lo)
        low, high = F.avg((F.col(p["name"]) <= lo + near).cast("int")), F.avg((F.col(p["name"]) >= hi - near).cast("int"))
        aggs.append(F.struct(F.lit(p["name"]).alias("param"), F.when(low > 0.5, "lower").when(high > 0.5, "upper").otherwise("none").alias("bound")))
    return top.groupBy(*by).agg(F.array(*aggs).alias("r")).select(*by, F.explode("r").alias("r")).select(*by, "r.*")


def diagnostics(groups: DataFrame, cross: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """Four flags, their number and the verdict (PASS, REVIEW, FAIL)."""
    g = groups.groupBy(*by).agg(
        F.sum(F.when(F.col("category") == "execution", F.col("s1"))).alias("_e"), F.sum("s1").alias("_s"), F.sum("st").alias("_t")
    )
    c = cross.groupBy(*by).agg(F.sum(F.when(F.col("category1") != F.col("category2"), F.col("s2")).otherwise(0.0)).alias("_c"))
    b = bounds.groupBy(*by).agg(F.max((F.col("bound") != "none").cast("int")).alias("_b"))
    d = g.join(c, by).join(b, by, "left").select(
        *by,
        ((F.col("_s") > 0) & (F.col("_e") / F.nullif("_s", F.lit(0.0)) > 0.5)).alias("execution_dominates"),
        (F.col("_c") > 0.3).alias("high_cross_group"),
        (F.col("_t") > 1.5).alias("low_additivity"),
        (F.coalesce("_b", F.lit(0)) == 1).alias("parameter_at_bound"),
    )
    flags = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in d.columns[len(by):]), F.lit(0))
    d = d.withColumn("n_flags", flags.cast("long")).fillna(False, subset=["execution_dominates"])
    return d.withColumn("verdict", F.when(F.col("n_flags") == 0, "PASS").when(F.col("n_flags") <= 2, "REVIEW").otherwise("FAIL"))


def _bin(name: str, bounds, n: int):
    lo, hi = bounds
    return F.least(F.greatest(F.width_bucket(F.col(name), F.lit(float(lo)), F.lit(float(hi)), F.lit(n)), F.lit(1)), F.lit(n)) - 1


def heatmap(results: DataFrame, problem: dict, p1: str, p2: str, metric: str, bins: int = 20) -> DataFrame:
    """bin1, bin2, mean: equal-width bins, values beyond the bounds in the end bins, a null mean where a cell is empty."""
    b = {p["name"]: p["bounds"] for p in problem["parameters"]}
    found = results.groupBy(_bin(p1, b[p1], bins).cast("long").alias("bin1"), _bin(p2, b[p2], bins).cast("long").alias("bin2")).agg(F.avg(metric).alias("mean"))
    cell = F.col("id")
    cells = results.sparkSession.range(bins * bins).select(F.floor(cell / bins).cast("long").alias("bin1"), (cell % bins).alias("bin2"))
    return cells.join(found, ["bin1", "bin2"], "left")


def sweep(results: DataFrame, problem: dict, param: str, metric: str, bins: int = 30) -> DataFrame:
    """bin, centre, mean, sample deviation of the metric along one parameter; nulls where a bin is empty."""
    lo, hi = next(p["bounds"] for p in problem["parameters"] if p["name"] == param)
    g = results.groupBy(_bin(param, (lo, hi), bins).cast("long").alias("bin")).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"))
    g = results.sparkSession.range(bins).withColumnRenamed("id", "bin").join(g, "bin", "left")
    return g.withColumn("centre", F.lit(float(lo)) + (F.col("bin") + 0.5) * ((hi - lo) / bins))


def top_params(idx: DataFrame, k: int, by: list[str]) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.desc("value"), "param")
    st = idx.filter("kind = 'ST'").withColumn("rank", F.row_number().over(w).cast("long"))
    return st.filter(F.col("rank") <= k).select(*by, "rank", "param", F.col("value").alias("st"))
