"""Planning of date windows: full walks, increments, gaps, splits and checkpoints.

The driver's part is plain Python on a handful of windows. The frame functions
plan for many datasets at once, with sequences instead of loops.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Window = tuple[date, date]
DONE_MARKER = 2  # a full walk that may be resumed


@dataclass(frozen=True)
class Plan:
    windows: list[Window]
    full: bool
    gap_days: int = 0


def chunks(start: date, end: date, days: int, newest_first: bool) -> list[Window]:
    """Closed ranges of at most ``days`` days that cover start..end; the last made is cut to fit."""
    days, out = max(1, days), []
    step = timedelta(days=days)
    if newest_first:
        while end >= start:
            out.append((max(start, end - step + timedelta(days=1)), end))
            end -= step
    else:
        while start <= end:
            out.append((start, min(end, start + step - timedelta(days=1))))
            start += step
    return out


def plan(today: date, start: date | None, chunk: int, lookback: int, last_from: date | None = None, last_to: date | None = None, marker: int = 0, full_done: bool = False) -> Plan:
    """The next windows of a dataset.

    Until the full walk is done it goes from today back to ``start`` (the fiscal
    year's by default), newest first; a resumed one goes on below its frontier.
    After that the window starts a day after the last one, or ``lookback`` days
    back if that is earlier, oldest first; days missed beyond the lookback are
    reported as a gap. Without a last day it starts at the lookback; a negative
    lookback is none.
    """
    target, lookback = start or fiscal_year_start(today), max(0, lookback)
    if not full_done:
        end = last_from - timedelta(days=1) if marker == DONE_MARKER and last_from else today
        return Plan(chunks(target, min(end, today), chunk, True), True)
    back = today - timedelta(days=lookback)
    resume = min(last_to + timedelta(days=1), today) if last_to else back
    return Plan(chunks(min(resume, back), today, chunk, False), False, max(0, (back - resume).days))


def fiscal_year_start(day: date) -> date:
    return date(day.year if day.month >= 4 else day.year - 1, 4, 1)


def rechunk(windows: list[Window], days: int, newest_first: bool) -> list[Window]:
    """Splits the windows wider than ``days``; their order stays, the pieces' is given."""
    out: list[Window] = []
    for a, b in windows:
        pieces = chunks(a, b, days, False)
        out += reversed(pieces) if newest_first else pieces
    return out


def halves(window: Window, newest_first: bool) -> list[Window]:
    """The two halves of a window that took too long; one of a single day stays whole."""
    a, b = window
    if a == b:
        return [window]
    mid = a + (b - a) // 2
    parts = [(a, mid), (mid + timedelta(days=1), b)]
    return parts[::-1] if newest_first else parts


def after_timeout(windows: list[Window], failed: int, newest_first: bool) -> tuple[list[Window], int]:
    """What is left to walk after the window ``failed`` took too long, and the width it is walked in.

    The window comes again as its halves, and those behind it are split to the
    width of the larger half. A window of a single day isn't tried again.
    """
    a, b = windows[failed]
    if a == b:
        return windows[failed + 1 :], 1
    parts = halves(windows[failed], newest_first)
    days = max((y - x).days + 1 for x, y in parts)
    return [*parts, *rechunk(windows[failed + 1 :], days, newest_first)], days


def after_slow(days: int, took: float, budget: float) -> int:
    """Half the window from then on if one took over six tenths of its budget."""
    return max(1, days // 2) if took > 0.6 * budget else days


def gate_open(seen: int | None, stored: int | None) -> bool:
    """Run unless the change mark is known and as stored."""
    return seen is None or stored is None or seen != stored


# ------------------------------------------------------------------- frames


def full_windows(df: DataFrame, start: str, today: str, chunk: int | Column) -> DataFrame:
    """Adds ord (from 0, newest first), window_from and window_to covering start..today."""
    n = F.lit(chunk) if isinstance(chunk, int) else chunk
    pieces = F.when(F.col(start) <= F.col(today), F.sequence(F.lit(0), F.floor(F.datediff(today, start) / n).cast("int"))).otherwise(F.array().cast("array<int>"))
    out = df.withColumn("_n", n.cast("int")).withColumn("ord", F.explode(pieces))
    end = F.date_add(F.col(today), -F.col("ord") * F.col("_n"))
    return out.withColumn("window_to", end).withColumn("window_from", F.greatest(F.col(start), F.date_add(end, 1 - F.col("_n")))).drop("_n")


def forward_windows(df: DataFrame, start: str, end: str, chunk: int) -> DataFrame:
    """Adds ord (from 0, oldest first), window_from and window_to covering start..end."""
    pieces = F.when(F.col(start) <= F.col(end), F.sequence(F.lit(0), F.floor(F.datediff(end, start) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
    out = df.withColumn("ord", F.explode(pieces))
    first = F.date_add(F.col(start), F.col("ord") * chunk)
    return out.withColumn("window_from", first).withColumn("window_to", F.least(F.col(end), F.date_add(first, chunk - 1)))


def incremental_bounds(last_to: Column, today: Column, lookback: int) -> tuple[Column, Column]:
    """The first day of the next increment, and the days missed beyond the lookback."""
    back = F.date_add(today, -max(0, lookback))
    resume = F.coalesce(F.least(F.date_add(last_to, 1), F.when(last_to.isNotNull(), today)), back)
    return F.least(resume, back), F.greatest(F.datediff(back, resume), F.lit(0))
