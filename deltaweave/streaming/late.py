"""Late data: what happens to a row whose window has closed when it arrives.

The watermark is the latest event time of all earlier epochs, as it was when the epoch began, so a batch never makes its own
rows late. A window is closed when the watermark is past its end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.operators import batch

POLICIES = ("drop", "update", "route")


def split_late(rows: DataFrame, ts: str, size: str, watermark, slide: str | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows), each with its window's start, once for each window with a `slide`. A retraction (`weight` below 0) is never late."""
    placed = batch.hop(rows, ts, size, slide) if slide else batch.tumble(rows, ts, size)
    if watermark is None:
        return placed, placed.limit(0)
    late = F.lit(watermark) > F.col("window_start") + F.expr(f"INTERVAL {size}")
    if weight is not None:
        late = late & (F.col(weight) > 0)
    return placed.filter(~late), placed.filter(late)


def split_late_sessions(rows: DataFrame, ts: str, gap: str, watermark) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows): a row is late if the session that it alone would make had ended, with its gap, before the mark."""
    known = rows.filter(F.col(ts).isNotNull())
    if watermark is None:
        return known, known.limit(0)
    late = F.lit(watermark) > F.col(ts) + F.expr(f"INTERVAL {gap}")
    return known.filter(~late), known.filter(late)


def open_windows(counted: DataFrame, size: str, watermark) -> DataFrame:
    """The windows that the mark has not passed: what a state must still keep. The others are closed and may be given out and forgotten."""
    return counted if watermark is None else counted.filter(F.lit(watermark) <= F.col("window_start") + F.expr(f"INTERVAL {size}"))


def late_windows(epochs: Sequence[DataFrame], ts: str, size: str, policy: str, slide: str | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(window_start, n) over all epochs, and the late rows set aside. With `weight`, rows are weighted changes and n is their net number.

    drop: late rows are not counted. update: their windows are opened again. route: they go to the second result alone.
    """
    if policy not in POLICIES:
        raise ValueError(f"{policy} is none of {POLICIES}")
    watermark, counted, aside = None, [], []
    for rows in epochs:
        good, late = split_late(rows, ts, size, watermark, slide, weight)
        counted.append(good.unionByName(late) if policy == "update" else good)
        aside.append(late.drop("window_start"))
        latest = rows.agg(F.max(ts)).first()[0]
        watermark = latest if watermark is None else max(watermark, latest or watermark)
    everything, routed = counted[0], aside[0]
    for c, a in zip(counted[1:], aside[1:], strict=True):
        everything, routed = everything.unionByName(c), routed.unionByName(a)
    n = F.sum(weight) if weight else F.count("*")
    return everything.groupBy("window_start").agg(n.alias("n")).filter("n <> 0"), routed
