"""Windows to look in, support of a context, merged ranges, and boundaries refined to edges and crossings."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.scoring import EXPANDED, UNCERTAIN
from spanloom.operators.tracks import worst

#: Fixed values, in milliseconds (CONTEXT: characters), and the least confidence of a speech edge.
PAD, LOCAL_PAD, AROUND, CONTEXT, STABLE = 800.0, 5000.0, 6000.0, 24, 80.0
SEARCH, EXPAND, CROSSING, SAFETY, LEAST_EDGE = 60, 20, 8, 5, 0.25
#: Fixed values of the stored format: what evidence a refined cut lacks.
CONFLICT, NO_START, NO_END, NO_START_CROSSING, NO_END_CROSSING, INVALID, GROWN = "adjacent_guard_conflict", "start_speech_edge_missing", "end_speech_edge_missing", "start_zero_crossing_missing", "end_zero_crossing_missing", "refined_interval_invalid", "boundary_expanded"
#: What a range says, by the names that track_ranges gives.
SAID = ("start_ms", "end_ms", "coverage", "mean_confidence", "min_confidence", "low_share", "precision", "margin", "valid", "confidence_coverage", "voice_start", "voice_end")


def search_window(located: Column, start: Column, end: Column, anchor: Column, next_anchor: Column, total: Column) -> Column:
    """Where to look for a paragraph: about its located range, else about its anchors."""
    low = F.when(located, start - LOCAL_PAD).otherwise(anchor - PAD)
    high = F.when(located, end + LOCAL_PAD).otherwise(F.coalesce(next_anchor, total) + PAD)
    return F.struct(F.greatest(low, F.lit(0.0)).alias("start"), F.least(high, total).alias("end"))


def local_window(range_: Column, context: Column, proportional: Column, total: Column) -> Column:
    """The window to refine in: the first of three ranges (start, end) that is there, widened."""
    r = F.coalesce(range_, context, proportional)
    return F.struct(F.greatest(r["start"] - AROUND, F.lit(0.0)).alias("start"), F.least(r["end"] + AROUND, total).alias("end"))


def is_supported(available: Column, supported: Column) -> Column:
    """Whether enough characters about a range are aligned: of at least four, six or all there are."""
    return (available >= 4) & (supported >= F.least(F.lit(6), available))


def averaged(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys and several ranges (as track_ranges gives them) as one: mean edges and confidence, the least coverage, confidence
    and margin, the largest share of low confidence, the coarsest precision, valid only if all are.

    spread is the largest difference between edges of the same kind, which says how stable they are.
    """
    return ranges.groupBy(*keys).agg(
        F.avg("start_ms").alias("start_ms"), F.avg("end_ms").alias("end_ms"), F.min("coverage").alias("coverage"), F.avg("mean_confidence").alias("mean_confidence"), F.min("min_confidence").alias("min_confidence"), F.max("low_share").alias("low_share"),
        worst(F.col("precision")).alias("precision"), F.min("margin").alias("margin"), F.bool_and("valid").alias("valid"), F.min("confidence_coverage").alias("confidence_coverage"), F.min("voice_start").alias("voice_start"), F.max("voice_end").alias("voice_end"),
        F.greatest(F.max("start_ms") - F.min("start_ms"), F.max("end_ms") - F.min("end_ms")).alias("spread"), F.count(F.lit(1)).alias("contexts"),
    )


def consensus(ranges: DataFrame, keys: list[str], order: str, most: float = STABLE) -> DataFrame:
    """keys and the range that several contexts of one target give: their mean if no edge differs by more than `most` ms
    (consensus, of two or more), else that of the first context in `order` (unstable)."""
    several = averaged(ranges, keys)
    first = ranges.groupBy(*keys).agg(F.min_by(F.struct(*SAID), order).alias("_first"))
    stable = F.col("spread") <= most
    rows = several.join(first, keys)
    told = [F.when(stable, F.col(c)).otherwise(F.col("_first")[c]).alias(c) for c in SAID]
    return rows.select(*keys, *told, (~stable).alias("unstable"), (stable & (F.col("contexts") > 1)).alias("consensus"), "contexts")


# --- boundaries: speech edges, guards, zero crossings


@dataclass(frozen=True)
class Edge:
    """Where speech begins or ends, how that was told, how surely, and the threshold below the peak in dB."""

    at: int
    method: str
    confidence: float = 0.0
    db: float | None = None

    @property
    def supported(self) -> bool:
        return self.method in ("vad", "energy") and self.confidence >= LEAST_EDGE


def energy_edge(energy: np.ndarray, predicted: int, rate: int, kind: str, low: int, high: int) -> Edge:
    """The edge in [low, high] nearest to predicted, where voice begins or ends that lasts two frames.

    Frames of 5 ms, one each 2.5 ms, about the range only; voice is 10 dB over their 20th
    percentile, or 35 dB below their peak if that is more.
    """
    width, hop = max(2, round(rate * 0.005)), max(1, round(rate * 0.0025))
    first, stop = max(0, low - width), min(energy.size, high + width + 1)
    if stop - first < width:
        return Edge(predicted, "model")
    frames = np.lib.stride_tricks.sliding_window_view(energy[first:stop], width)[::hop]
    rms = np.sqrt(np.mean(np.square(frames), axis=1))
    peak = float(rms.max())
    if peak <= 1e-9:
        return Edge(predicted, "model")
    threshold = max(float(np.percentile(rms, 20)) * 10**0.5, peak * 10 ** (-35 / 20), 1e-9)
    voiced = rms >= threshold
    stable = np.append(voiced[:-1] & voiced[1:], False)
    begins = first + hop * np.arange(rms.size)
    before = np.insert(stable[:-1], 0, False)
    found = begins[stable & ~before] if kind == "start" else begins[~stable & before] + width
    found = found[(found >= low) & (found <= high)]
    if not found.size:
        return Edge(predicted, "model")
    sure = min(1.0, max(0.0, (peak - threshold) / peak))
    return Edge(int(found[np.argmin(np.abs(found - predicted))]), "energy", sure, 20 * math.log10(max(1e-12, threshold / peak)))


def crossing(signal: np.ndarray, at: int, rate: int, low: int, high: int, ms: float) -> int | None:
    """The zero crossing within ms of `at`, in [low, high], that is quietest and nearest: 0.75 of the RMS over 2.5 ms on
    either side by the largest in reach, and 0.25 of the distance by the reach. None without one."""
    reach = round(rate * ms / 1000)
    first, last = max(0, low, at - reach), min(signal.size - 1, high, at + reach)
    if last < first:
        return None
    part = signal[first : last + 1]
    crosses = part == 0
    crosses[1:] |= np.signbit(part[1:]) != np.signbit(part[:-1])
    found = np.flatnonzero(crosses)
    if not found.size:
        return None
    side = max(1, round(rate * 0.0025))
    total = np.concatenate([[0.0], np.cumsum(np.square(part))])
    a, b = np.maximum(np.arange(part.size) - side, 0), np.minimum(np.arange(part.size) + side + 1, part.size)
    rms = np.sqrt(np.maximum(total[b] - total[a], 0) / (b - a))
    score = 0.75 * rms[found] / (rms.max() or 1.0) + 0.25 * np.abs(found + first - at) / max(1, reach)
    return int(found[np.argmin(score)] + first)


def channels(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(energy, signal) of samples x channels: RMS over channels, so that opposite phases don't cancel, and the loudest
    channel, the first on ties."""
    if samples.shape[1] == 1:
        return np.abs(samples[:, 0]), samples[:, 0]
    return np.sqrt(np.mean(np.square(samples), axis=1)), samples[:, int(np.argmax(np.mean(np.square(samples), axis=0)))]


def cut_at(samples: np.ndarray, start: int, end: int, rate: int, guards: tuple[int | None, int | None] = (None, None), vad: tuple[int | None, int | None] = (None, None)) -> dict:
    """A cut [start, end) of samples x channels, its ends moved to speech edges and zero crossings.

    Outward only towards a guard, that is where a neighbouring character is known, and never
    closer to it than SAFETY ms. The end is sought behind the refined start. What is no interval
    reverts to the prediction. reasons say what evidence is missing.
    """
    energy, signal = channels(samples)
    n = len(energy)
    if n < 2:
        return {"refined_start": 0, "refined_end": max(1, n), "expanded": False, "reasons": ["empty_pcm"], "start_edge": Edge(0, "model"), "end_edge": Edge(0, "model"), "start_crossing": None, "end_crossing": None}
    start = max(0, min(n - 1, start))
    end = max(start + 1, min(n, end))
    look, grow, safe = (round(rate * ms / 1000) for ms in (SEARCH, EXPAND, SAFETY))

    def side(kind: str, predicted: int, low: int, high: int, heard: int | None) -> tuple[int, Edge, int | None]:
        if high < low:
            return predicted, Edge(predicted, "guard_conflict"), None
        if heard is not None and low <= heard <= high and abs(heard - predicted) <= look:
            edge = Edge(heard, "vad", 1.0)
        else:
            edge = energy_edge(energy, predicted, rate, kind, low, high)
        if not edge.supported:
            return predicted, edge, None
        at = crossing(signal, min(n - 1, edge.at), rate, min(n - 1, low), min(n - 1, high), CROSSING)
        return edge.at if at is None else at, edge, at

    low = start if guards[0] is None else max(0, start - grow, guards[0] + safe)
    a, first, cross_a = side("start", start, low, min(n - 1, start + look, end - 1), vad[0])
    high = end if guards[1] is None else min(n, end + grow, guards[1] - safe)
    b, last, cross_b = side("end", end, max(a + 1, end - look), high, vad[1])
    invalid = not 0 <= a < b <= n
    conflict = "guard_conflict" in (first.method, last.method)
    if invalid:
        a, b, cross_a, cross_b = start, end, None, None
        first, last = Edge(first.at, "model", first.confidence, first.db), Edge(last.at, "model", last.confidence, last.db)
    expanded = a < start or b > end
    told = {CONFLICT: conflict, NO_START: not first.supported, NO_END: not last.supported, NO_START_CROSSING: cross_a is None, NO_END_CROSSING: cross_b is None, INVALID: invalid, GROWN: expanded}
    return {"refined_start": a, "refined_end": b, "expanded": expanded, "reasons": [r for r, holds in told.items() if holds], "start_edge": first, "end_edge": last, "start_crossing": cross_a, "end_crossing": cross_b}


REFINED = "refined_start long, refined_end long, expanded boolean, review_required boolean, review_reasons array<string>, start_method string, start_confidence double, start_db double, end_method string, end_confidence double, end_db double"


def refine(candidates: DataFrame, signal: DataFrame, id_column: str, key: str, rate: int) -> DataFrame:
    """candidates with refined bounds and the evidence for them (REFINED).

    Reads predicted_start/end, left_guard, right_guard, vad_start, vad_end in samples, and signal
    (key, sample, v, and channel where there are several). Only the samples about a candidate
    are brought to it: both sides meet in cells of the window's size, so no signal is in one task.
    Cuts of fewer than three samples, and those whose samples are not there, get no refined bounds.
    """
    names = ["predicted_start", "predicted_end", "left_guard", "right_guard", "vad_start", "vad_end"]
    radius = max(1, round(rate * (SEARCH + EXPAND + CROSSING) / 1000))
    cell = 4 * radius
    if "channel" not in signal.columns:
        signal = signal.withColumn("channel", F.lit(0))
    blocks = signal.groupBy(key, F.floor(F.col("sample") / cell).alias("_cell")).agg(F.array_sort(F.collect_list(F.struct("sample", "channel", F.col("v").cast("double").alias("v")))).alias("_samples"))
    asked = candidates.select(id_column, key, *[F.col(c).cast("long").alias(c) for c in names]).where("predicted_end - predicted_start >= 3")
    low, high = F.greatest(F.lit(0), F.col("predicted_start") - radius), F.col("predicted_end") + radius
    near = F.array_distinct(F.concat(F.sequence(F.floor(low / cell), F.floor((F.col("predicted_start") + radius) / cell)), F.sequence(F.floor(F.greatest(F.lit(0), F.col("predicted_end") - radius) / cell), F.floor(high / cell))))
    met = asked.withColumn("_cell", F.explode(near)).join(blocks, [key, "_cell"])
    part = F.filter("_samples", lambda x: (x["sample"] >= low) & (x["sample"] < high))
    grouped = met.select(id_column, *names, part.alias("_part")).groupBy(id_column, *names).agg(F.flatten(F.collect_list("_part")).alias("_samples"))

    def run(batches):
        for pdf in batches:
            rows = []
            for i, *told, found in pdf.itertuples(index=False):
                start, end, *others = (None if x is None or x != x else int(x) for x in told)
                at = np.array([x["sample"] for x in found], np.int64)
                if not at.size:
                    continue
                first, width = max(0, start - radius), max(x["channel"] for x in found) + 1
                pcm = np.zeros((int(at.max()) + 1 - first, width))
                pcm[at - first, [x["channel"] for x in found]] = [x["v"] for x in found]
                left, right, va, vb = (None if x is None else x - first for x in others)
                r = cut_at(pcm, start - first, end - first, rate, (left, right), (va, vb))
                a, b = r["start_edge"], r["end_edge"]
                db = lambda e: None if e.db is None else round(e.db, 3)
                rows.append((i, r["refined_start"] + first, r["refined_end"] + first, r["expanded"], bool(r["reasons"]), r["reasons"], a.method, round(a.confidence, 4), db(a), b.method, round(b.confidence, 4), db(b)))
            yield pd.DataFrame(rows, columns=[id_column, *(c.split()[0] for c in REFINED.split(", "))])

    kind = dict(candidates.dtypes)[id_column]
    done = grouped.mapInPandas(run, f"`{id_column}` {kind}, {REFINED}")
    return candidates.join(done, id_column, "left")


def applied(candidates: DataFrame, refined: DataFrame, id_column: str) -> DataFrame:
    """candidates (start, end, reasons, status) with refined bounds; incomplete evidence is a reason and sends a candidate to
    review, and so is a boundary moved outward. Candidates without refined bounds stay as they are."""
    r = refined.select(id_column, "refined_start", "refined_end", F.col("review_required").alias("_review"), F.col("expanded").alias("_expanded"))
    rows = candidates.join(r, id_column, "left").withColumn("_use", F.col("refined_start").isNotNull() & (F.col("refined_end") > F.col("refined_start")))
    review, grown = F.col("_use") & F.coalesce("_review", F.lit(False)), F.col("_use") & F.coalesce("_expanded", F.lit(False))
    added = F.array_compact(F.array(F.when(review, F.lit(UNCERTAIN)), F.when(grown, F.lit(EXPANDED))))
    rows = rows.withColumn("reasons", F.array_distinct(F.concat("reasons", added))).withColumn("status", F.when(review, "needs_review").otherwise(F.col("status")))
    if "review_required" in candidates.columns:
        rows = rows.withColumn("review_required", F.col("review_required") | review)
    rows = rows.withColumn("start", F.when(F.col("_use"), F.col("refined_start")).otherwise(F.col("start"))).withColumn("end", F.when(F.col("_use"), F.col("refined_end")).otherwise(F.col("end")))
    return rows.select(*candidates.columns)
