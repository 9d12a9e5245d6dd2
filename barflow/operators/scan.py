"""Running state over long symbols: scans that go chunk by chunk.

A running maximum, sum or last value needs everything before a bar. Over chunks it splits in
two: what the chunk has before the bar (a window over the chunk) and what earlier chunks
end with (a table of one row a chunk, itself scanned). State that follows from other state,
as a flag from a trend from a swing, is a scan over a scan: each level sees the finished
level below. So no window ever holds a symbol's bars, however many there are. What a level reads is
written once to the shared folder, for both of its parts, so that levels add up and do not
multiply.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import numbered, with_history
from ..functions.schema import KEYS
from ..sources.shared import stored

CHUNK = (*KEYS, "_chunk")


@dataclass(frozen=True)
class Scan:
    """``kind`` (max, sum or last) of a column over all bars up to this one, or up to the one before."""

    kind: str
    of: Column
    before: bool = False


def _over(kind: str, c: Column, w) -> Column:
    return {"max": F.max, "sum": F.sum}[kind](c).over(w) if kind != "last" else F.last(c, ignorenulls=True).over(w)


def _both(kind: str, here: Column, earlier: Column) -> Column:
    """What stands so far, of what the chunk and what earlier chunks have."""
    if kind == "max":
        return F.greatest(here, earlier)  # passes over nulls
    if kind == "last":
        return F.coalesce(here, earlier)
    return F.when(here.isNotNull() | earlier.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0)))


def scan(df: DataFrame, scans: dict[str, Scan], keys: tuple[str, ...] = CHUNK, order: str = "close_ts") -> DataFrame:
    """``df`` with one column for each of ``scans``; ``keys`` end with the number of the chunk.

    Sums and maxima pass over nulls, and are null where there is nothing yet.
    """
    *own, chunk = keys
    inputs = {f"_in_{n}": s.of for n, s in scans.items()}
    df = stored(df.withColumns(inputs))
    ends = df.groupBy(*keys).agg(*[
        (F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col(order))) if s.kind == "last" else getattr(F, s.kind)(f"_in_{n}")).alias(f"_end_{n}")
        for n, s in scans.items()
    ])
    chunks = Window.partitionBy(*own).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*[F.col(k).alias(f"_at_{k}") for k in keys], *[_over(s.kind, F.col(f"_end_{n}"), chunks).alias(f"_start_{n}") for n, s in scans.items()])
    w = Window.partitionBy(*keys).orderBy(order)
    frame = {before: w.rowsBetween(Window.unboundedPreceding, -1 if before else 0) for before in (False, True)}
    here = df.withColumns({f"_here_{n}": _over(s.kind, F.col(f"_in_{n}"), frame[s.before]) for n, s in scans.items()})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    out = here.join(starts, same, "left")
    return out.withColumns({n: _both(s.kind, F.col(f"_here_{n}"), F.col(f"_start_{n}")) for n, s in scans.items()}).drop(
        *inputs, *[f"_at_{k}" for k in keys], *[f"_{part}_{n}" for n in scans for part in ("here", "start")]
    )


def in_chunks(bars: DataFrame, chunk_rows: int, lookback: int, local: dict[str, Column]) -> DataFrame:
    """Bars with ``_chunk``, ``bar_idx`` and the ``local`` columns, which look back ``lookback`` bars at most.

    ``local`` columns are windows by ``CHUNK`` and close_ts; they see the bars before the
    chunk too, which are gone afterwards.
    """
    if chunk_rows < 1:
        raise ValueError("a chunk has one bar at least")
    return with_history(numbered(bars, chunk_rows), chunk_rows, lookback).withColumns(local).filter("not _history").drop("_history")
