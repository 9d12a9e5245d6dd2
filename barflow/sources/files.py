"""Kline files and payloads in, enriched bars out."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The twelve headerless columns of a kline file.
KLINE_COLUMNS = (
    "open_time open high low close volume close_time quote_vol trades taker_buy_base taker_buy_quote ignore"
).split()
_NUMBER = r"^[+-]?[0-9]*[.]?[0-9]+([eE][+-]?[0-9]+)?$"
_INTEGER = r"^[+-]?[0-9]+$"


def _parse(df: DataFrame, symbol: Column, timeframe: Column) -> tuple[DataFrame, DataFrame]:
    """Bars, and the rows in which one of the first seven fields is missing or no number."""
    kinds = {"open_time": "long", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "close_time": "long"}
    ok, parsed = F.lit(True), {}
    for name, kind in kinds.items():
        c = F.col(name)
        fits = c.rlike(_INTEGER if kind == "long" else _NUMBER)
        parsed[name] = F.when(fits, c.try_cast(kind))
        ok = ok & parsed[name].isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    bars = df.filter(ok).select(
        symbol.alias("symbol"), timeframe.alias("timeframe"), parsed["open_time"].alias("open_ts"),
        parsed["close_time"].alias("close_ts"), *[parsed[n].alias(n) for n in ("open", "high", "low", "close", "volume")],
    )
    return bars, df.filter(~ok)


def read_klines_csv(
    spark: SparkSession, path: str, symbol: str | Column | None = None, timeframe: str | Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Bars and bad rows of headerless 12-column files. A header or a short row is just a bad row.

    ``symbol`` and ``timeframe`` are texts or columns (as of ``_metadata``); without them they come from
    file names like ``BTCUSDT-1h-2024-01.csv``.
    """
    return parse_klines(spark.read.schema(KLINE_SCHEMA).csv(path, **KLINE_OPTIONS), symbol, timeframe)


KLINE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in [*KLINE_COLUMNS, "_raw"]])
KLINE_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw", "ignoreLeadingWhiteSpace": False}
_NAME = r"([A-Z0-9]+)-(\w+)-\d{4}-\d{2}"


def parse_klines(df: DataFrame, symbol: str | Column | None = None, timeframe: str | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Bars and bad rows of a table or stream of kline files' rows."""
    file = F.col("_metadata.file_name")
    return _parse(
        df,
        F.lit(symbol) if symbol is not None else F.regexp_extract(file, _NAME, 1),
        F.lit(timeframe) if timeframe is not None else F.regexp_extract(file, _NAME, 2),
    )


def parse_kline_json(df: DataFrame, body: str, symbol: str | Column, timeframe: str | Column) -> DataFrame:
    """Bars from JSON arrays of arrays; short rows are dropped, a price that is no number is 0.0.

    ``symbol`` and ``timeframe`` are texts or columns of ``df``.
    """
    rows = df.select(F.lit(symbol).alias("_symbol"), F.lit(timeframe).alias("_timeframe"), F.posexplode(F.from_json(body, "array<array<string>>")).alias("pos", "k"))
    rows = rows.filter(F.size("k") >= 7)
    num = lambda i: F.coalesce(F.get("k", i).try_cast("double"), F.lit(0.0))
    out = rows.select(
        F.col("_symbol").alias("symbol"), F.col("_timeframe").alias("timeframe"), F.get("k", 0).try_cast("long").alias("open_ts"),
        F.get("k", 6).try_cast("long").alias("close_ts"), num(1).alias("open"), num(2).alias("high"), num(3).alias("low"),
        num(4).alias("close"), num(5).alias("volume"),
    )
    return out.filter("open_ts is not null and close_ts is not null")


#: Lines of an archive's member that a task holds at a time.
LINES = 100_000


def read_kline_archives(spark: SparkSession, glob: str, months: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Bars and bad rows of zip archives: the first ``.csv`` member of each. No file at all is an error.

    With ``months`` (like ``2024-01``) only archives of theirs are read, and each month without one is
    warned of. A member is inflated piece by piece.
    """
    files = spark.read.format("binaryFile").load(glob)
    if months is not None:
        month = F.regexp_extract("path", r"(\d{4}-\d{2})\.zip$", 1)
        files = files.filter(month.isin(months))
        found = {r[0] for r in files.select(month).distinct().collect()}  # of the months asked for
        for m in months:
            if m not in found:
                warnings.warn(f"no archive of {m} matches {glob}", stacklevel=2)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for path, content in zip(df["path"], df["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = next((m for m in z.namelist() if m.endswith(".csv")), None)
                    if member is None:
                        continue
                    with io.TextIOWrapper(z.open(member), "utf-8", "replace") as text:
                        while part := [x.rstrip("\r\n") for x in islice(text, LINES)]:
                            yield pd.DataFrame([(path, x) for x in part if x], columns=["path", "line"])

    if not files.select("path").head(1):
        raise FileNotFoundError(f"no archive matches {glob}")
    cut = files.select("path", "content").mapInPandas(lines, "path string, line string").select("path", F.split("line", ",").alias("f"))
    df = cut.select("path", *[F.get("f", i).alias(c) for i, c in enumerate(KLINE_COLUMNS)])
    return _parse(df, F.regexp_extract("path", _NAME, 1), F.regexp_extract("path", _NAME, 2))


def month_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row for each calendar month from start's to end's, both included."""
    span = f"sequence(trunc(date'{start}', 'MM'), trunc(date'{end}', 'MM'), interval 1 month)"
    return spark.sql(f"SELECT explode({span}) AS month")


def write_enriched(df: DataFrame, path: str) -> None:
    """JSON lines, one folder for each symbol and timeframe; absent features are left out."""
    df.withColumnRenamed("close_ts", "timestamp").write.partitionBy("symbol", "timeframe").json(path)


def read_enriched(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    df = (spark.read.schema(schema) if schema else spark.read).json(path)
    return df.withColumn("time", F.timestamp_millis("timestamp"))


def read_results(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A results table with header; missing columns are named in the error."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in columns else F.col(c) for c in df.columns])


def write_samples(df: DataFrame, path: str, csv: bool = False) -> None:
    df.write.csv(path, header=True) if csv else df.write.parquet(path)


def write_analysis(tables: dict[str, DataFrame], path: str) -> None:
    """Each analysis table under its name, in long form: the keys that its columns are, and every number.

    kind (the table), key (the texts of a row, joined by "/"), name (of the number), value.
    """
    for name, df in tables.items():
        numbers = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "boolean")]
        key = F.concat_ws("/", *[F.col(c) for c, t in df.dtypes if t == "string"])
        long = df.select(key.alias("key"), *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(["key"], numbers, "name", "value")
        long.write.mode("overwrite").parquet(f"{path}/kind={name}")


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    """kind, key, name, value of all tables that ``write_analysis`` wrote."""
    return spark.read.schema("key string, name string, value double, kind string").parquet(path).select("kind", "key", "name", "value")


def list_pairs(info: DataFrame, quote: str | None = None, search: str | None = None) -> DataFrame:
    """Trading pairs of an exchange-info document."""
    s = info.select(F.explode("symbols").alias("s")).select("s.*").filter(F.col("status") == "TRADING")
    if quote:
        s = s.filter(F.col("quoteAsset") == quote.upper())
    return s.filter(F.lower("symbol").contains(search.lower())) if search else s


def list_tickers(tickers: DataFrame, quote: str | None = None, symbol: str | None = None) -> DataFrame:
    t = tickers
    if quote:
        t = t.filter(F.col("symbol").endswith(quote.upper()))
    if symbol:
        t = t.filter(F.col("symbol") == symbol.upper())
    return t.select("symbol", *[F.col(c).try_cast("double").alias(c) for c in t.columns if c != "symbol"])
