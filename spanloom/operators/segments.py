"""Segments of timed tokens: by silence, by silence and length, and by voice ranges."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators.folds import fold


def by_gap(tokens: DataFrame, keys: list[str], order: list[str], start: str, end: str, gap: int) -> DataFrame:
    """tokens with segment (from 0): a new one where a token starts `gap` or more after the furthest end."""
    line = Window.partitionBy(*keys).orderBy(*order)
    before = F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) - before >= gap, 1).otherwise(0)
    return tokens.withColumn("_new", new).withColumn("segment", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def by_gap_or_length(tokens: DataFrame, keys: list[str], order: list[str], start: str, end: str, gap: int, longest: int) -> DataFrame:
    """keys, token (from 0), start, segment: also a new segment where one would be `longest` or more.

    The segment's start moves with each cut, so this is a fold over the tokens of a key in order.
    """

    def step(state, s, e):
        origin, before, segment, n = state
        if origin is None or s - before >= gap or s - origin >= longest:
            origin, segment = s, segment + 1
        return (origin, e, segment, n + 1), n, segment

    rows = tokens.select(*keys, *dict.fromkeys([*order, start, end]))
    told = fold(rows, keys, order, [start, end], "token long, segment long", lambda: (None, None, -1, 0), step)
    return told.select(*keys, "token", F.col(start).alias("start"), "segment")


#: Tolerance and least length of a timestamp in ms, and the codes of what is rejected.
EPSILON, SHORTEST = 5.0, 5.0
UNREADABLE, INVALID, OUTSIDE, COLLAPSED, BACKWARDS = "timestamp_pair_invalid", "timestamp_interval_invalid", "timestamp_outside_window", "timestamp_collapsed_after_clamp", "timestamp_not_monotonic"


def judged(s: float | None, e: float | None, limit: float | None, latest: tuple[float, float]) -> tuple[str | None, float, float]:
    """(code, start, end) of a timestamp relative to its window: code None if it is accepted, start and end within the window then.

    limit is the length of the window, if known; latest the largest start and end accepted before.
    """
    if s is None or e is None:
        return UNREADABLE, 0.0, 0.0
    if not (isfinite(s) and isfinite(e)) or s < -EPSILON or e - s < SHORTEST:
        return INVALID, 0.0, 0.0
    if limit is not None and e > limit + EPSILON:
        return OUTSIDE, 0.0, 0.0
    s, e = max(0.0, s), e if limit is None else min(limit, e)
    if e - s < SHORTEST:
        return COLLAPSED, 0.0, 0.0
    if s + EPSILON < latest[0] or e + EPSILON < latest[1]:
        return BACKWARDS, 0.0, 0.0
    return None, s, e


def accepted_timestamps(rows: DataFrame, keys: list[str], order: list[str], start: str, end: str, scale: float = 1.0, from_ms: str | None = None, to_ms: str | None = None) -> DataFrame:
    """keys, token (from 0), start_ms, end_ms, code: timestamps checked against their window and what was accepted before.

    start and end count from the window's start, in milliseconds after scaling; from_ms and
    to_ms name columns with the window. A rejected row has a code and no times, and moves
    nothing: a running maximum can't say that, as it would take rejected rows along.
    """
    window = [F.col(c).cast("double") if c else F.lit(d).cast("double") for c, d in ((from_ms, 0.0), (to_ms, None))]
    told = rows.select(*keys, *dict.fromkeys(order), F.col(start).cast("double").alias("_s"), F.col(end).cast("double").alias("_e"), window[0].alias("_from"), window[1].alias("_to"))

    def step(state, s, e, first, last):
        latest, n = state
        code, a, b = judged(None if s is None else s * scale, None if e is None else e * scale, None if last is None else max(0.0, last - first), latest)
        if code:
            return (latest, n + 1), n, None, None, code
        return ((max(latest[0], a), max(latest[1], b)), n + 1), n, a + first, b + first, None

    found = fold(told, keys, order, ["_s", "_e", "_from", "_to"], "token long, start_ms double, end_ms double, code string", lambda: ((-1.0, -1.0), 0), step)
    return found.select(*keys, "token", "start_ms", "end_ms", "code")


def by_voice(tokens: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """key, boundary, token: segment starts from voice ranges.

    Between two ranges lies a boundary, halfway; it picks the first token (token, mid) at or
    behind it, and each pick has to be later than the one before.
    """
    line = Window.partitionBy(key).orderBy("start", "end")
    bounds = ranges.withColumn("_next", F.lead("start").over(line)).where("_next IS NOT NULL").select(key, ((F.col("end") + F.col("_next")) / 2).alias("boundary"))
    marks = bounds.select(key, "boundary", F.lit(None).cast("long").alias("token"), F.col("boundary").alias("at"), F.lit(0).alias("kind"))
    rows = marks.unionByName(tokens.select(key, F.lit(None).cast("double").alias("boundary"), F.col("token").cast("long").alias("token"), F.col("mid").cast("double").alias("at"), F.lit(1).alias("kind")))
    after = Window.partitionBy(key).orderBy("at", "kind", "token").rowsBetween(0, Window.unboundedFollowing)
    picks = rows.withColumn("token", F.min("token").over(after)).where("kind = 0 AND token IS NOT NULL").select(key, "boundary", "token")
    return picks.groupBy(key, "token").agg(F.min("boundary").alias("boundary"))
