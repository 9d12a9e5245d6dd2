"""Shared pieces of the text operators: table access, shared folder, word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete_dir, shared_dir

#: White space that separates words in the contracts: space, \t, \n, \v, \f, \r.
WHITE = "\t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables between the steps of one operator; each can be deleted once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self._at = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete_dir(self.spark, self._at.pop(id(t))[1])


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as array<string>; null text has none."""
    parts = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def parallelism(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Partitions for ``rows`` rows: at least the session's, more as data grows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


#: Ids of 8 bytes: 2 million of them make a hash relation of about 64 MB.
MAX_BROADCAST_IDS = 2_000_000


def only_ids(df: DataFrame, ids: DataFrame, key: str, without: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (or is not). Broadcast up to a checked size."""
    few = ids.count() <= MAX_BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti" if without else "left_semi")
