"""Prefix sums over a range-sorted table, so that no key's rows ever meet in one task.

Rows are dealt by range of (keys, order); a key that holds a third of all rows is spread over
a third of the partitions. Inside a partition a window sums up what stands before a row;
what earlier partitions hold of the same key is one row a partition, which is broadcast:
in a sorted table only the first key of a partition can have rows in earlier ones, so there
are never more such rows than partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism

#: Rows of a partition, about.
ROWS = 1_000_000


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], rows: int = ROWS) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over the rows of the key before this one.

    ``df`` is read from a stored table, so that it has the same rows whenever it is read, and
    ``order`` ends with a column that is unique, so that the order is a total one. Nulls come
    first, and null keys are a key like others.
    """
    n = parallelism(df.sparkSession, df.count(), rows)
    ranged = materialize(df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("_pid", *keys).agg(*[F.sum(c).alias(f"_o_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    offsets = parts.select(
        F.col("_pid").alias("_at"), *[F.col(k).alias(v) for k, v in named.items()], F.count(F.lit(1)).over(earlier).alias("_n"),
        *[F.sum(f"_o_{name}").over(earlier).alias(f"_o_{name}") for name in sums],
    ).filter("_n > 0").drop("_n")
    inside = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()})
    same = F.col("_pid") == F.col("_at")
    for k, v in named.items():
        same = same & F.col(k).eqNullSafe(F.col(v))
    both = here.join(F.broadcast(offsets), same, "left")
    total = {name: (F.coalesce(name, F.lit(0)) + F.coalesce(f"_o_{name}", F.lit(0))).alias(name) for name in sums}
    return both.select(*df.columns, *total.values())
