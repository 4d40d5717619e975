"""Sampled signals in long form: envelopes, energy edges and zero crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def samples(blocks: DataFrame, key: str, values: str) -> DataFrame:
    """key, sample (from 0), v of a column of arrays."""
    return blocks.select(F.col(key), F.posexplode(values).alias("sample", "v")).select(key, F.col("sample").cast("long").alias("sample"), F.col("v").cast("double").alias("v"))


def envelope(signal: DataFrame, key: str, size: int) -> DataFrame:
    """key, block, min, max, rms of each block of `size` samples; a part of a block at the end counts."""
    return signal.groupBy(key, F.floor(F.col("sample") / size).alias("block")).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


def points_block(frames: int, rate: int, points: int = 200, least: int = 12_000, most: int = 600_000) -> int:
    """The block size of one envelope with about so many points a second, between `least` and `most` of them."""
    return max(1, -(-frames // min(most, max(least, round(frames / rate * points)))))


def probed(signal: DataFrame, key: str, size: int) -> DataFrame:
    """envelope's columns and frames, the samples that each signal has: one pass over the samples for both."""
    rows = signal.groupBy(key, F.floor(F.col("sample") / size).alias("block")).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.count(F.lit(1)).alias("_n"))
    return rows.withColumn("frames", F.sum("_n").over(Window.partitionBy(key))).drop("_n")


def window_of(signal: DataFrame, key: str, start_ms: float, end_ms: float, rate: int) -> DataFrame:
    """signal between two times, its samples counted from the window's start. The bounds reach the scan as a filter on sample."""
    first, last = max(0, round(start_ms * rate / 1000)), round(end_ms * rate / 1000)
    return signal.where((F.col("sample") >= first) & (F.col("sample") < last)).withColumn("sample", F.col("sample") - first)


def halved(level: DataFrame, key: str) -> DataFrame:
    """The next level: blocks in pairs. The mean square is not weighted, even for a part at the end."""
    return level.groupBy(key, F.floor(F.col("block") / 2).alias("block")).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("rms"))


def pyramid(signal: DataFrame, key: str, base: int, levels: int, stop: int, longest: int) -> DataFrame:
    """key, level, block_size, block, min, max, rms: levels until one has at most `stop` points.

    longest: samples of the longest signal, which says how many levels there are.
    """
    level, out, points, n = envelope(signal, key, base), None, -(-longest // base), 0
    while True:
        told = level.select(key, F.lit(n).alias("level"), F.lit(base << n).cast("long").alias("block_size"), "block", "min", "max", "rms")
        out = told if out is None else out.unionByName(told)
        n += 1
        if n >= levels or points <= stop:
            return out
        level, points = halved(level, key), -(-points // 2)


def viewport(level: DataFrame, key: str, first: int, last: int, most: int) -> DataFrame:
    """key, bucket, min, max: blocks first..last-1 in at most `most` buckets, extremes kept."""
    step = max(1, -(-(last - first) // most))
    rows = level.where((F.col("block") >= first) & (F.col("block") < last))
    return rows.groupBy(key, F.floor((F.col("block") - first) / step).alias("bucket")).agg(F.min("min").alias("min"), F.max("max").alias("max"))


#: Samples of a block in which neighbours are looked up.
BLOCK = 1 << 20


def with_neighbour(signal: DataFrame, key: str, ahead: bool) -> DataFrame:
    """signal with _near, the value of the next (ahead) or previous sample, null at the end of the signal.

    Signals are cut into blocks, and the sample beyond a block's edge goes to both, so a task
    holds a block and never a whole signal.
    """
    step = 1 if ahead else -1
    own = F.floor(F.col("sample") / BLOCK)
    other = F.floor((F.col("sample") - step) / BLOCK)
    rows = signal.withColumn("_block", F.explode(F.when(own == other, F.array(own)).otherwise(F.array(own, other)))).withColumn("_own", F.col("_block") == own)
    line = Window.partitionBy(key, "_block").orderBy("sample")
    near = F.lead("v").over(line) if ahead else F.lag("v").over(line)
    return rows.withColumn("_near", near).where("_own").drop("_own", "_block")


def resampled(signal: DataFrame, key: str, rate: int, to: int = 16_000) -> DataFrame:
    """key, sample, v at another rate, between neighbours in proportion; the signal as it is at the same rate."""
    if rate == to:
        return signal.select(key, "sample", "v")
    rows = with_neighbour(signal, key, ahead=True).withColumnRenamed("_near", "_after")
    first, last = F.ceil(F.col("sample") * to / rate), F.ceil((F.col("sample") + 1) * to / rate) - 1
    rows = rows.withColumn("_last", F.when(F.col("_after").isNull(), F.when(first == F.col("sample") * to / rate, first)).otherwise(last)).where(F.col("_last") >= first)
    rows = rows.withColumn("_k", F.explode(F.sequence(first, F.col("_last"))))
    part = F.col("_k") * rate / to - F.col("sample")
    return rows.select(key, F.col("_k").alias("sample"), (F.col("v") + part * (F.coalesce("_after", "v") - F.col("v"))).alias("v"))


def mono(signal: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sample, v: the mean over channels."""
    return signal.groupBy(*keys, "sample").agg(F.avg("v").alias("v"))


def loudest_channel(signal: DataFrame, keys: list[str]) -> DataFrame:
    """keys, channel, rms: the channel of largest RMS, the lowest on ties."""
    rms = signal.groupBy(*keys, "channel").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    best = F.max_by(F.struct("channel", "rms"), F.struct(F.col("rms"), -F.col("channel")))
    return rms.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.channel", "b.rms")


def frames(signal: DataFrame, key: str, width: int, hop: int) -> DataFrame:
    """key, frame, rms of whole frames of `width` samples, one each `hop`."""
    last = F.floor(F.col("sample") / hop)
    first = F.greatest(F.lit(0), F.ceil((F.col("sample") - width + 1) / hop))
    rows = signal.withColumn("frame", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return rows.groupBy(key, "frame").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == width).drop("_n")


def thresholds(framed: DataFrame, key: str) -> DataFrame:
    """key, threshold: 10 dB over the 20th percentile, 35 dB below the peak, or 1e-9, whichever is most."""
    floor = F.percentile("rms", F.lit(0.2)) * F.pow(F.lit(10.0), F.lit(10 / 20))
    return framed.groupBy(key).agg(F.greatest(floor, F.max("rms") * F.pow(F.lit(10.0), F.lit(-35 / 20)), F.lit(1e-9)).alias("threshold"))


def energy_edges(signal: DataFrame, key: str, width: int, hop: int) -> DataFrame:
    """key, kind (start or end), edge: where voice that lasts two frames begins and ends.

    A frame is stable if it and the next are voiced; an edge is where that changes, so a frame
    and its two neighbours tell it, and blocks of frames with their edges are enough.
    """
    framed = frames(signal, key, width, hop)
    rows = framed.join(thresholds(framed, key), key).select(key, F.col("frame").alias("sample"), (F.col("rms") >= F.col("threshold")).alias("v"))
    own, before, after = (F.floor((F.col("sample") + k) / BLOCK) for k in (0, -1, 1))
    rows = rows.withColumn("_block", F.explode(F.when((before == own) & (after == own), F.array(own)).otherwise(F.array_distinct(F.array(own, before, after))))).withColumn("_own", F.col("_block") == own)
    line = Window.partitionBy(key, "_block").orderBy("sample")
    on = lambda c: F.coalesce(c, F.lit(False))
    stable, was = F.col("v") & on(F.lead("v").over(line)), F.col("v") & on(F.lag("v").over(line))
    rows = rows.withColumns({"_stable": stable, "_was": was}).where("_own")
    edge = F.when(F.col("_stable") & ~F.col("_was"), F.struct(F.lit("start").alias("kind"), (F.col("sample") * hop).alias("edge"))).when(~F.col("_stable") & F.col("_was"), F.struct(F.lit("end").alias("kind"), (F.col("sample") * hop + width).alias("edge")))
    return rows.select(key, edge.alias("e")).where("e IS NOT NULL").select(key, "e.kind", F.col("e.edge").cast("long").alias("edge"))


def nearest_edge(edges: DataFrame, key: str, predicted: int, kind: str) -> DataFrame:
    """key, edge: the edge of that kind nearest to predicted, the first on ties."""
    return edges.where(F.col("kind") == kind).groupBy(key).agg(F.min_by("edge", F.struct(F.abs(F.col("edge") - predicted), F.col("edge"))).alias("edge"))


def zero_crossings(signal: DataFrame, key: str) -> DataFrame:
    """signal's rows that are zero, or whose sign bit differs from the sample before."""
    negative = lambda v: (v < 0) | (v.cast("string") == "-0.0")
    rows = with_neighbour(signal, key, ahead=False)
    return rows.where((F.col("v") == 0) | (F.col("_near").isNotNull() & (negative(F.col("v")) != negative(F.col("_near"))))).drop("_near")


def best_crossing(signal: DataFrame, key: str, predicted: int, low: int, high: int, reach: int, radius: int) -> DataFrame:
    """key, crossing: in [low, high] and within reach of predicted, the crossing of least score.

    The score is 0.75 local energy (RMS over radius on either side, by the largest in reach)
    plus 0.25 distance (by reach); predicted itself where there is no crossing. Only the samples
    in reach are looked at, so the first of them is a crossing only if it is zero.
    """
    near = signal.where((F.col("sample") >= max(low, predicted - reach)) & (F.col("sample") <= min(high, predicted + reach)))
    line = Window.partitionBy(key).orderBy("sample")
    power = F.sqrt(F.avg(F.col("v") * F.col("v")).over(line.rowsBetween(-radius, radius)))
    peak = F.max("_p").over(Window.partitionBy(key))
    rows = near.withColumn("_p", power).withColumn("_peak", F.when(peak > 0, peak).otherwise(1.0))
    score = F.round(0.75 * (F.col("_p") / F.col("_peak")) + 0.25 * (F.abs(F.col("sample") - predicted) / max(1, reach)), 9)
    best = zero_crossings(rows, key).withColumn("_score", score).groupBy(key).agg(F.min_by("sample", F.struct("_score", "sample")).alias("crossing"))
    return signal.select(key).distinct().join(best, key, "left").select(key, F.coalesce("crossing", F.lit(predicted).cast("long")).alias("crossing"))


def channel_rms(signal: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sample, v: the root of the mean square over channels, which opposite phases don't cancel."""
    return signal.groupBy(*keys, "sample").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("v"))
