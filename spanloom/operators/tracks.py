"""Tracks: recognised speech mapped onto a reference text, ranges of it, guards beside it, and calls of recognisers.

A raw result is JSON of no fixed shape, so reading one, with the alignment of its text to the
reference, is one Arrow function a result. What follows works on spans as rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from math import isfinite

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from spanloom.functions.text import normalize_with_origin
from spanloom.operators.align import aligned, line_of
from spanloom.operators.intervals import overlaps
from spanloom.operators.options import option_key
from spanloom.operators.segments import EPSILON, judged

#: Fixed values of the format: keys of raw results, in the order in which they count.
TIMES = ("timestamp", "timestamps", "time_stamp")
VOICE = ("value", "segments", "vad", "sentence_info")
STARTS, ENDS = ("start", "start_ms", "begin"), ("end", "end_ms", "stop")
TEXTS, TOKENS, TOKEN_TEXTS = ("text", "sentence", "transcript"), ("tokens", "token"), ("text", "token", "word", "value")
ITEM_CONFIDENCES = ("token_confidence", "token_confidences", "confidences", "scores", "confidence", "score")
CONFIDENCES = ("confidence", "score", "probability", "prob")
#: Precisions from fine to coarse, silence that parts segments, confidence that is low.
PRECISIONS = ("character", "token", "segment", "unknown")
RANK = {p: i for i, p in enumerate(PRECISIONS)}
SILENCE, LOW = 500.0, 0.5
TAG = re.compile(r"<[^>]+>")


def _struct(**kinds: DataType) -> StructType:
    return StructType([StructField(n, k) for n, k in kinds.items()])


_D, _S, _L, _B = DoubleType(), StringType(), LongType(), BooleanType()
SPAN = _struct(a=_L, b=_L, start_ms=_D, end_ms=_D, confidence=_D, model_confidence=_D, precision=_S, margin=_D)
VOICED = _struct(start=_D, end=_D)
#: A track, and a recognised character.
TRACK = _struct(engine=_S, coverage=_D, mean_confidence=_D, min_confidence=_D, low_share=_D, precision=_S, valid=_B, margin=_D, diagnostics=ArrayType(_S), confidence_coverage=_D, voice=ArrayType(VOICED), spans=ArrayType(SPAN))
TOKEN = _struct(position=_L, text=_S, start_ms=_D, end_ms=_D, confidence=_D, confidence_available=_B, precision=_S)


def _with_key(df: DataFrame, key: str, rest: StructType) -> StructType:
    return StructType([df.schema[key], *rest])


# --- reading a raw result


def plain(text: str) -> str:
    return normalize_with_origin(text)[0]


def first_of(record: Mapping, keys: Sequence[str], default: object = None) -> object:
    """The value of the first key that is there, even if it is null."""
    return next((record[k] for k in keys if k in record), default)


def is_list(value: object) -> bool:
    return isinstance(value, Sequence) and not isinstance(value, str | bytes)


def number(value: object) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError, OverflowError):
        return None


def probability(value: object) -> float | None:
    """A number from 0 to 1; a boolean is none."""
    x = None if isinstance(value, bool) else number(value)
    return x if x is not None and isfinite(x) and 0 <= x <= 1 else None


def pair_of(value: object) -> tuple[float | None, float | None]:
    """Start and end of a record or of a list, of which the last two numbers count; nulls if there are none."""
    if isinstance(value, Mapping):
        return number(first_of(value, STARTS)), number(first_of(value, ENDS))
    found = [x for part in value if not isinstance(part, bool) and (x := number(part)) is not None] if is_list(value) else []
    return (found[-2], found[-1]) if len(found) > 1 else (None, None)


def records(result: object) -> Iterator[Mapping]:
    """The records of a result, however deep its lists are nested."""
    if isinstance(result, Mapping):
        yield result
    elif is_list(result):
        for part in result:
            yield from records(part)


def timestamps(raw: object, scale: float, first: float, last: float | None) -> tuple[list[tuple[int, float, float]], list[str]]:
    """(index, start, end) of what is accepted, and a code with the index for each of the rest."""
    kept, codes, latest = [], [], (-1.0, -1.0)
    for i, value in enumerate(raw if is_list(raw) else ()):
        s, e = (None if x is None else x * scale for x in pair_of(value))
        code, s, e = judged(s, e, None if last is None else max(0.0, last - first), latest)
        if code:
            codes.append(f"{code}:{i}")
        else:
            kept.append((i, s + first, e + first))
            latest = max(latest[0], s), max(latest[1], e)
    return kept, codes


def voice_of(result: object, scale: float, first: float, last: float | None) -> list[tuple[float, float]]:
    """Voice ranges of all records and keys, merged where they touch."""
    found = sorted((s, e) for r in records(result) for k in VOICE for _, s, e in timestamps(r.get(k), scale, first, last)[0])
    merged: list[tuple[float, float]] = []
    for s, e in found:
        if merged and s <= merged[-1][1] + EPSILON:
            merged[-1] = merged[-1][0], max(merged[-1][1], e)
        else:
            merged.append((s, e))
    return merged


def serialized(text: str) -> list[str]:
    """The tokens of `token start end;` records."""
    parts = (p.strip().rsplit(maxsplit=2) for p in text.split(";"))
    return [p[0] for p in parts if len(p) == 3 and number(p[1]) is not None and number(p[2]) is not None and p[0].strip()]


def fine(tokens: Sequence[str]) -> list[str]:
    """The precision of each token: a single character's time is its own."""
    return [PRECISIONS[0] if len(plain(t)) == 1 else PRECISIONS[1] for t in tokens]


def tokens_of(record: Mapping, n: int, reference: str, forced: bool) -> tuple[list[str], list[str], list[float | None]] | None:
    """Tokens of a record's n timestamps, their precisions and confidences; None where no text was recognised.

    The first that fits: the reference itself, if timestamps were forced on it one by one; serialised
    tokens; a list of tokens; parts between blanks; single characters; characters shared out.
    """
    text, listed = str(first_of(record, TEXTS, "")), first_of(record, TOKENS)
    if forced and n == len(reference):
        return list(reference), [PRECISIONS[0]] * n, []
    if forced and len(told := serialized(text)) == n:
        return told, fine(told), []
    if is_list(listed):
        told = [str(first_of(t, TOKEN_TEXTS, "")) if isinstance(t, Mapping) else str(t) for t in listed]
        sure = [next((p for k in CONFIDENCES if k in t and (p := probability(t[k])) is not None), None) if isinstance(t, Mapping) else None for t in listed]
        return told, fine(told), sure
    text = TAG.sub("", text)
    if len(told := text.split()) == n:
        return told, fine(told), []
    letters = plain(text) or (reference if forced else "")
    if not letters:
        return None
    if len(letters) == n:
        return list(letters), [PRECISIONS[0]] * n, []
    edges = [round(i * len(letters) / n) for i in range(n + 1)]
    return [letters[a:b] for a, b in zip(edges, edges[1:], strict=False)], [PRECISIONS[1]] * n, []


def own_confidences(record: Mapping, n: int) -> list[float | None]:
    """Confidences of a record's n timestamps: a list as long as these; a single number only for a single one."""
    for k in ITEM_CONFIDENCES:
        value = record.get(k)
        if is_list(value):
            if len(value) == n:
                return [probability(x) for x in value]
        elif n == 1 and (p := probability(value)) is not None:
            return [p]
    return [None] * n


@dataclass
class Heard:
    """What a result says: characters as (letter, start, end, confidence, precision, segment), codes of problems, voice ranges."""

    voice: list[tuple[float, float]]
    letters: list[tuple[str, float, float, float | None, str, int]] = field(default_factory=list)
    codes: list[str] = field(default_factory=list)
    part: int = 0
    until: float | None = None

    def add(self, token: str, s: float, e: float, confidence: float | None, precision: str) -> None:
        """A timed token: each of its characters has its whole interval, and its confidence only if it is alone."""
        if not self.voice and self.until is not None and s - self.until >= SILENCE:
            self.part += 1
        mid = (s + e) / 2
        part = next((i for i, (a, b) in enumerate(self.voice) if a - EPSILON <= mid <= b + EPSILON), self.part)
        letters = plain(TAG.sub("", token))
        self.letters += [(c, s, e, confidence if len(letters) == 1 else None, precision, part) for c in letters]
        self.until = e if self.until is None else max(self.until, e)


def heard(result: object, reference: str = "", forced: bool = False, scale: float = 1.0, first: float = 0.0, last: float | None = None) -> Heard:
    """The characters of a result with their times, by the precedence of its shapes."""
    out = Heard(voice_of(result, scale, first, last))
    for record in records(result):
        raw = first_of(record, TIMES)
        if raw is None:
            out.codes.append("timestamps_missing")
        pairs, codes = timestamps(raw, scale, first, last)
        out.codes += codes
        if not pairs:
            spoken = record.get("sentence_info")
            pairs, codes = timestamps(spoken, scale, first, last)
            out.codes += codes
            for i, s, e in pairs:
                if isinstance(spoken[i], Mapping):
                    sure = next((p for k in CONFIDENCES if (p := probability(spoken[i].get(k))) is not None), None)
                    out.add(str(spoken[i].get("text", "")), s, e, sure, PRECISIONS[2])
            continue
        told = tokens_of(record, len(raw), reference, forced)
        if told is None:
            continue
        tokens, precisions, sure = told
        others = own_confidences(record, len(raw))
        for i, s, e in pairs:
            if i >= len(tokens):
                out.codes.append(f"timestamp_without_token:{i}")
                continue
            out.add(tokens[i], s, e, sure[i] if i < len(sure) and sure[i] is not None else others[i], precisions[i])
    if not out.letters and not out.codes:
        out.codes.append("timestamped_tokens_unavailable")
    out.codes = list(dict.fromkeys(out.codes))
    return out


def confidence_facts(found: Sequence[float | None]) -> tuple[float | None, float | None, float | None, float]:
    """Mean, least, share of low ones and share of known ones of model confidences."""
    known = [x for x in found if x is not None]
    if not known:
        return None, None, None, 0.0
    return sum(known) / len(known), min(known), sum(x < LOW for x in known) / len(known), len(known) / len(found)


def track_of(result: object, transcript: str, engine: str, forced: bool = False, scale: float = 1.0, first: float = 0.0, last: float | None = None, alike: dict[str, str] | None = None) -> dict:
    """A track (see TRACK): the result's characters aligned to the transcript."""
    reference, origin = normalize_with_origin(transcript)
    empty = {"engine": engine, "coverage": 0.0, "mean_confidence": None, "min_confidence": None, "low_share": None, "precision": PRECISIONS[3], "valid": True, "margin": 1.0, "diagnostics": [], "confidence_coverage": 0.0, "voice": [], "spans": []}
    if not reference:
        return empty
    told = heard(result, reference, forced, scale, first, last)
    found = aligned(reference, "".join(x[0] for x in told.letters), None if forced else alike, line_of(transcript, origin), [x[5] for x in told.letters])
    margins = dict(found.margins)
    spans = sorted(({"a": i, "b": i + 1, "start_ms": told.letters[j][1], "end_ms": told.letters[j][2], "confidence": c, "model_confidence": told.letters[j][3], "precision": told.letters[j][4], "margin": margins.get(i, 1.0)} for i, j, c in found.matches), key=lambda x: (x["a"], x["start_ms"]))
    mean, least, low, known = confidence_facts([x["model_confidence"] for x in spans])
    notes = [*told.codes, f"timestamp_unit:{'seconds' if scale == 1000 else 'milliseconds'}", "matching_strategy:anchored_monotonic_dp"]
    notes += ["dp_forced_partition"] * found.split + ["vad_ranges_unavailable"] * (not told.voice and not forced)
    return empty | {
        "coverage": len({x["a"] for x in spans}) / len(reference), "mean_confidence": mean, "min_confidence": least, "low_share": low, "precision": max((x["precision"] for x in spans), key=RANK.__getitem__, default=PRECISIONS[3]),
        "valid": not told.codes, "margin": found.margin, "diagnostics": list(dict.fromkeys(notes)), "confidence_coverage": known, "voice": [{"start": s, "end": e} for s, e in told.voice], "spans": spans,
    }


def _rows_of(kinds: StructType, rows: list[dict]) -> list[pa.Array]:
    return [pa.array([r[f.name] for r in rows], to_arrow_type(f.dataType)) for f in kinds]


def tracks_from_results(results: DataFrame, key: str, raw: str = "raw", alike: dict[str, str] | None = None) -> DataFrame:
    """key and a track of each row of results: raw (JSON), transcript, engine, forced, seconds, first_ms, last_ms (null: open)."""

    def run(batches):
        for batch in batches:
            rows = []
            for _, result, text, engine, forced, seconds, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(track_of(json.loads(result), text or "", engine, bool(forced), 1000.0 if seconds else 1.0, first or 0.0, last, alike))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_rows_of(TRACK, rows)], [key, *TRACK.names])

    return results.select(key, F.col(raw), "transcript", "engine", "forced", "seconds", F.col("first_ms").cast("double"), F.col("last_ms").cast("double")).mapInArrow(run, _with_key(results, key, TRACK))


def tokens_from_results(results: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """key and the characters of each row of results (raw, seconds, first_ms, last_ms), in the order of their times.

    A confidence that is not known is 0 and said to be not available.
    """

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for k, result, seconds, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                letters = sorted(heard(json.loads(result), scale=1000.0 if seconds else 1.0, first=first or 0.0, last=last).letters, key=lambda x: x[1:3])
                rows += [{"position": i, "text": c, "start_ms": s, "end_ms": e, "confidence": p or 0.0, "confidence_available": p is not None, "precision": of} for i, (c, s, e, p, of, _) in enumerate(letters)]
                keys += [k] * len(letters)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *_rows_of(TOKEN, rows)], [key, *TOKEN.names])

    return results.select(key, F.col(raw), "seconds", F.col("first_ms").cast("double"), F.col("last_ms").cast("double")).mapInArrow(run, _with_key(results, key, TOKEN))


def voice_ranges(results: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """key, start, end of the merged voice ranges of results (raw, seconds, first_ms, last_ms)."""

    def run(batches):
        for pdf in batches:
            rows = [(k, s, e) for k, r, seconds, first, last in pdf.itertuples(index=False) for s, e in voice_of(json.loads(r), 1000.0 if seconds else 1.0, first, None if pd.isna(last) else last)]
            yield pd.DataFrame(rows, columns=[key, "start", "end"])

    return results.select(key, F.col(raw), "seconds", F.coalesce(F.col("first_ms").cast("double"), F.lit(0.0)).alias("first_ms"), F.col("last_ms").cast("double").alias("last_ms")).mapInPandas(run, _with_key(results, key, VOICED))


# --- calls of recognisers and aligners


class Unavailable(RuntimeError):
    """A model that is not there: the call counts as not made."""


_MODELS: dict[str, object] = {}


def kept(options: object, load: Callable[[], object]) -> object:
    """What load() gives for these options, loaded once a worker: a plug-in calls it for its model."""
    key = option_key(options)
    if key not in _MODELS:
        _MODELS[key] = load()
    return _MODELS[key]


def coerced(value: object, engine: str, length: int) -> dict:
    """A track from what an aligner gave: a record with spans, or a list of spans, of loose types.

    What is missing is taken from the spans. Raises TypeError or ValueError for what is no track.
    """
    given = value if isinstance(value, Mapping) else {"spans": value}
    raw = first_of(given, ("spans",))
    if not is_list(raw):
        raise TypeError("spans are no list")
    spans = []
    for x in raw:
        sure = x.get("model_confidence")
        span = {
            "a": int(first_of(x, ("normalized_start", "start_char", "text_start", "a"))), "b": int(first_of(x, ("normalized_end", "end_char", "text_end", "b"))), "start_ms": float(x["start_ms"]), "end_ms": float(x["end_ms"]),
            "confidence": float(x.get("confidence", 1.0)), "model_confidence": None if sure is None else float(sure), "precision": str(first_of(x, ("timestamp_precision", "precision"), PRECISIONS[3])), "margin": float(first_of(x, ("alignment_margin", "margin"), 1.0)),
        }
        spans.append(span)
    mean, least, _, known = confidence_facts([x["model_confidence"] for x in spans])
    covered = {p for x in spans for p in range(x["a"], x["b"])}
    pick = lambda name, other, default: first_of(given, (name, other), default)
    track = {
        "engine": str(given.get("engine", engine)), "coverage": float(given["coverage"]) if given.get("coverage") is not None else min(1.0, len(covered) / max(1, length)),
        "mean_confidence": pick("mean_model_confidence", "mean_confidence", mean), "min_confidence": pick("minimum_model_confidence", "min_confidence", least), "low_share": pick("low_confidence_ratio", "low_share", None),
        "precision": str(pick("timestamp_precision", "precision", max((x["precision"] for x in spans), key=lambda p: RANK.get(p, 9), default=PRECISIONS[3]))), "valid": pick("timestamp_valid", "valid", True), "margin": float(pick("ambiguity_margin", "margin", 1.0)),
        "diagnostics": [str(x) for x in given.get("diagnostics") or ()], "confidence_coverage": float(pick("model_confidence_coverage", "confidence_coverage", known)),
        "voice": [{"start": float(first_of(v, STARTS)), "end": float(first_of(v, ENDS))} if isinstance(v, Mapping) else {"start": float(v[0]), "end": float(v[1])} for v in first_of(given, ("vad_ranges", "voice"), ()) or ()], "spans": spans,
    }
    if problem := next(track_problems(track), None):
        raise ValueError(problem)
    return track


def track_problems(track: Mapping) -> Iterator[str]:
    """What is wrong with a track: spans or voice ranges that are none or go backwards, shares out of 0 to 1, unknown precisions."""
    share = lambda x: x is None or (isinstance(x, int | float) and isfinite(x) and 0 <= x <= 1)
    if not isinstance(track["valid"], bool):
        yield "valid"
    if track["coverage"] is None or not all(share(track[k]) for k in ("coverage", "mean_confidence", "min_confidence", "low_share", "margin", "confidence_coverage")):
        yield "share"
    if track["precision"] not in RANK:
        yield "precision"
    a, latest = -1, (-1.0, -1.0)
    for x in track["spans"]:
        s, e = x["start_ms"], x["end_ms"]
        if x["a"] < 0 or x["b"] <= x["a"] or not (isfinite(s) and isfinite(e)) or s < 0 or e <= s or not (share(x["confidence"]) and share(x["model_confidence"]) and share(x["margin"])) or x["precision"] not in RANK:
            yield "span"
        elif x["a"] < a:
            yield "text_order"
        elif s + EPSILON < latest[0] or e + EPSILON < latest[1]:
            yield "time_order"
        a, latest = x["a"], (max(latest[0], s), max(latest[1], e))
    latest = (-1.0, -1.0)
    for v in track["voice"]:
        s, e = v["start"], v["end"]
        if not (isfinite(s) and isfinite(e)) or s < 0 or e <= s:
            yield "voice"
        elif s + EPSILON < latest[0] or e + EPSILON < latest[1]:
            yield "voice_order"
        latest = max(latest[0], s), max(latest[1], e)


def answered(call: Callable[[], object], engine: str, length: int) -> dict | None:
    """The track of a call, by the error policy: a missing model or an unknown error gives none, a
    malformed result an empty track that is not valid and says why."""
    try:
        value = call()
        return None if value is None else coerced(value, engine, length)
    except Unavailable:
        return None
    except (TypeError, ValueError, OverflowError, KeyError, AttributeError) as why:
        name = type(why).__name__ if isinstance(why, TypeError | ValueError | OverflowError) else "TypeError"
        return track_of(None, "", engine) | {"valid": False, "diagnostics": [f"aligner_result_rejected:{name}"]}
    except Exception:  # noqa: BLE001  a plug-in may raise anything; the caller records that there is no track
        return None


def invoked(requests: DataFrame, aligner: Callable[..., object] | None, key: str) -> DataFrame:
    """key and a track for each request (key, audio, transcript, engine, first_ms, last_ms) that an aligner answers.

    aligner(audio, transcript, first_ms, last_ms) is the plug-in, a recogniser or a forced aligner; it
    runs in Arrow batches on the executors, where it may keep a loaded model for the worker.
    """
    schema = _with_key(requests, key, TRACK)
    if aligner is None:
        return requests.sparkSession.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for k, audio, text, engine, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                track = answered(lambda a=audio, t=text, f=first, e=last: aligner(a, t, f, e), engine, len(plain(text or "")))
                if track is not None:
                    keys.append(k)
                    rows.append(track)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *_rows_of(TRACK, rows)], [key, *TRACK.names])

    return requests.select(key, "audio", "transcript", "engine", F.col("first_ms").cast("double"), F.col("last_ms").cast("double")).mapInArrow(run, schema)


# --- ranges of tracks


def spans_of(tracks: DataFrame, key: str) -> DataFrame:
    return tracks.select(key, F.explode("spans").alias("s")).select(key, "s.*")


def voice_spans(tracks: DataFrame, key: str) -> DataFrame:
    return tracks.select(key, F.explode("voice").alias("v")).select(key, "v.start", "v.end")


def worst(precision: Column) -> Column:
    """The coarsest precision of a group."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    return F.max_by(precision, F.try_element_at(rank, precision))


def track_ranges(wanted: DataFrame, tracks: DataFrame, key: str, id_column: str, width: int = 64) -> DataFrame:
    """id and what a track says of positions [low, high) of its text, for wanted rows (key, id, low, high, cap, max_gap_ms).

    start_ms, end_ms, coverage, mean/min_confidence, low_share, precision, margin, valid,
    confidence_coverage, voice_start, voice_end. A span that reaches beyond is cut, its times in
    proportion. No row where no span touches the positions, or where a silence between spans,
    in the order of the text, is longer than max_gap_ms (null: any). cap: the track's own
    coverage is a bound too. Spans meet ranges in cells of positions, never all with all.
    """
    spans = spans_of(tracks, key).withColumnsRenamed({"a": "r_start", "b": "r_end"})
    left = wanted.select(key, id_column, F.col("low").alias("l_start"), F.col("high").alias("l_end"), "cap", "max_gap_ms").where("l_end > l_start")
    met = overlaps(left, spans, [key], width)
    a, b, wide = F.greatest("l_start", "r_start"), F.least("l_end", "r_end"), F.col("r_end") - F.col("r_start")
    time = lambda at: F.col("start_ms") + (at - F.col("r_start")) / wide * (F.col("end_ms") - F.col("start_ms"))
    cut = met.withColumn("_a", a).withColumn("_b", b).withColumn("_s", time(a)).withColumn("_e", time(b))
    line = Window.partitionBy(id_column).orderBy("_a", "_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_gap", F.col("_s") - F.max("_e").over(line)).withColumn("_new", F.greatest(F.lit(0), F.col("_b") - F.greatest(F.col("_a"), F.coalesce(F.max("_b").over(line), F.col("_a")))))
    low = F.count_if(F.col("model_confidence") < LOW) / F.nullif(F.count("model_confidence"), F.lit(0))
    told = cut.groupBy(id_column, key).agg(
        F.min("_s").alias("start_ms"), F.max("_e").alias("end_ms"), (F.sum("_new") / F.max(F.col("l_end") - F.col("l_start"))).alias("_coverage"), F.avg("model_confidence").alias("mean_confidence"), F.min("model_confidence").alias("min_confidence"),
        low.alias("low_share"), worst(F.col("precision")).alias("precision"), F.min("margin").alias("margin"), (F.count("model_confidence") / F.count(F.lit(1))).alias("confidence_coverage"),
        F.max("_gap").alias("_gap"), F.max("max_gap_ms").alias("_most"), F.max("cap").alias("_cap"),
    )
    told = told.where(F.coalesce(F.col("_gap") <= F.col("_most"), F.lit(True)))
    heads = tracks.select(key, F.col("coverage").alias("_all"), "valid")
    told = told.join(heads, key).withColumn("coverage", F.when(F.col("_cap"), F.least("_coverage", "_all")).otherwise(F.col("_coverage")))
    voice = told.select(key, id_column, "start_ms", "end_ms").join(voice_spans(tracks, key), key).where("end >= start_ms AND start <= end_ms").groupBy(id_column).agg(F.min("start").alias("voice_start"), F.max("end").alias("voice_end"))
    told = told.join(voice, id_column, "left")
    return told.select(id_column, "start_ms", "end_ms", "coverage", "mean_confidence", "min_confidence", "low_share", "precision", "margin", "valid", "confidence_coverage", "voice_start", "voice_end")


def range_guards(wanted: DataFrame, tracks: DataFrame, key: str, id_column: str) -> DataFrame:
    """id, left_ms, right_ms for wanted rows (key, id, low, high): the latest end of the spans wholly before, the earliest start of
    those wholly after; null where there are none, both null where they cross."""
    spans = spans_of(tracks, key).select(key, "a", "b", "start_ms", "end_ms")
    # spans and ranges in one line of positions: running extremes instead of a join of all with all
    mark = lambda at, kind, s, e: [F.col(key), at.alias("at"), F.lit(kind).alias("kind"), s.alias("s"), e.alias("e")]
    none = F.lit(None).cast("double")
    ends = spans.select(*mark(F.col("b"), 0, none, F.col("end_ms")), F.lit(None).cast(dict(wanted.dtypes)[id_column]).alias(id_column))
    asks = wanted.select(*mark(F.col("low"), 1, none, none), id_column)
    before = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    left = ends.unionByName(asks).withColumn("left_ms", F.max("e").over(before)).where("kind = 1").select(id_column, "left_ms")
    starts = spans.select(*mark(F.col("a"), 1, F.col("start_ms"), none), F.lit(None).cast(dict(wanted.dtypes)[id_column]).alias(id_column))
    asks = wanted.select(*mark(F.col("high"), 0, none, none), id_column)
    after = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    right = starts.unionByName(asks).withColumn("right_ms", F.min("s").over(after)).where("kind = 0").select(id_column, "right_ms")
    both = left.join(right, id_column)
    crossed = F.coalesce(F.col("right_ms") <= F.col("left_ms"), F.lit(False))
    return both.select(id_column, F.when(~crossed, F.col("left_ms")).alias("left_ms"), F.when(~crossed, F.col("right_ms")).alias("right_ms"))
