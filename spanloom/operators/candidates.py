"""From marked paragraphs and recognised speech to judged cut candidates, in stages.

The whole audio is recognised first and mapped onto the whole text; each mark is then refined by
recognition about its place, and checked by forced alignment of two contexts of it. Each call
of a model is a row of a table of requests, and its tracks are stored before they are used, so a
stage that is read twice calls nothing twice. Everything between the calls is joins and
expressions. Times of the document serve only where the audio doesn't tell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import labels
from spanloom.functions import text as T
from spanloom.operators import refine, scoring
from spanloom.operators.tracks import TRACK, invoked, range_guards, track_ranges
from spanloom.plans.session import stored

#: Shares of a range that let it count, the longest silence in a mark, radii and padding of forced contexts.
LOCATED, CONTEXT_SEEN, EXCERPT_SEEN, GAP = 0.20, 0.20, 0.35, 1500.0
RADII, EXCERPT_PAD, BESIDE = (10, 20), 450, 8
#: Names of the calls.
GLOBAL, ANCHOR_ASR, ANCHOR_FORCE, REFINEMENT, EXCERPT = "paraformer-zh+fsmn-vad-global", "paraformer-zh+fsmn-vad-anchor-fallback", "fa-zh-anchor-fallback", "paraformer-zh+fsmn-vad-highlight-refinement", "fa-zh-context"
Aligner = Callable[[str, str, float, float], object]


def padded(start: Column, end: Column, pad: float, last: Column) -> tuple[Column, Column]:
    """A window about [start, end], in whole milliseconds, within the audio."""
    a = F.greatest(F.lit(0), F.floor(start).cast("long") - int(pad))
    return a, F.least(last, F.floor(end + 0.999999).cast("long") + int(pad))


def prefixed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Ranges (key and what track_ranges says) with each column behind name_."""
    return df.select(F.col(key), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key])


def wanted(rows: DataFrame, track: str | Column, id_column: str, low: Column, high: Column, cap: bool = False, gap: float | None = None) -> DataFrame:
    return rows.select((F.col(track) if isinstance(track, str) else track).alias("track"), F.col(id_column).alias("id"), low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(cap).alias("cap"), F.lit(gap).cast("double").alias("max_gap_ms"))


def ranges(asks: DataFrame, tracks: DataFrame) -> DataFrame:
    return track_ranges(asks, tracks, "track", "id")


def requests(rows: DataFrame, key: str, transcript: str, engine: Column | str, first: Column | str, last: Column | str) -> DataFrame:
    named = F.lit(engine) if isinstance(engine, str) else engine
    return rows.select(F.col(key).alias("track"), "audio", F.col(transcript).alias("transcript"), named.alias("engine"), F.col(first).alias("first_ms") if isinstance(first, str) else first.alias("first_ms"), F.col(last).alias("last_ms") if isinstance(last, str) else last.alias("last_ms"))


def located(paragraphs: DataFrame, audio: DataFrame, asr: Aligner | None) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, tracks): each paragraph with its place in the text, its range in the whole audio's track if at least
    LOCATED of it was heard, and the window in which to look for it; and the track of each document."""
    rows = T.normalized_any(paragraphs, "text").withColumn("pid", F.concat_ws(":", "doc", "paragraph")).withColumn("size", F.length("norm"))
    line = Window.partitionBy("doc").orderBy("paragraph")
    rows = rows.withColumn("base", F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).withColumn("_next", F.lead("anchor_ms").over(line)).join(audio, "doc")
    rate, total = F.col("sample_rate"), F.col("total_samples")
    rows = rows.withColumn("duration_ms", total * 1000.0 / rate).withColumn("last_ms", F.greatest(F.lit(1).cast("long"), F.ceil(total * 1000 / rate).cast("long")))
    rows = rows.withColumn("core_start", F.greatest(F.lit(0.0), F.least("duration_ms", F.col("anchor_ms").cast("double"))))
    rows = stored(rows.withColumn("core_end", F.greatest("core_start", F.least("duration_ms", F.coalesce(F.col("_next").cast("double"), "duration_ms")))).drop("_next"), "paragraphs")
    whole = rows.groupBy("doc", "audio", "last_ms").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]), "\n").alias("whole"))
    tracks = stored(invoked(requests(whole.withColumn("doc", F.col("doc").cast("string")), "doc", "whole", GLOBAL, F.lit(0.0), "last_ms"), asr, "track"), "global-tracks")
    seen = prefixed(ranges(wanted(rows, F.col("doc").cast("string"), "pid", F.col("base"), F.col("base") + F.col("size")), tracks), "id", "seen").where(F.col("seen_coverage") >= LOCATED)
    rows = rows.join(seen.select(F.col("id").alias("pid"), "seen_start_ms", "seen_end_ms"), "pid", "left").withColumn("located", F.col("seen_start_ms").isNotNull())
    near, far = padded(F.col("seen_start_ms"), F.col("seen_end_ms"), refine.LOCAL_PAD, F.col("last_ms")), padded(F.col("core_start"), F.col("core_end"), refine.PAD, F.col("last_ms"))
    rows = rows.withColumn("from_ms", F.when(F.col("located"), near[0]).otherwise(far[0])).withColumn("to_ms", F.when(F.col("located"), near[1]).otherwise(far[1]))
    return rows.withColumn("to_ms", F.when(F.col("to_ms") <= F.col("from_ms"), F.least(F.bround("duration_ms").cast("long"), F.col("from_ms") + 1)).otherwise(F.col("to_ms"))), tracks


def placed(highlights: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """highlights (doc, paragraph, highlight, start, end, text, before, after) with the normalised range [low, high) in their
    paragraph, and whether they are repeated in the document; those without a letter, or out of their paragraph, go."""
    corpus = paragraphs.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "norm"))), lambda x: x["norm"]), "").alias("corpus"))
    marks = T.normalized_columns(highlights.withColumnRenamed("text", "marked"), ["marked", "before", "after"])
    text = paragraphs.select("doc", "paragraph", "pid", "audio", "text", "norm", "origin", "size", "base", "located", "seen_start_ms", "seen_end_ms", "core_start", "core_end", "last_ms", "duration_ms", "sample_rate", "total_samples")
    rows = marks.join(text, ["doc", "paragraph"]).where((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("text")))
    rows = rows.withColumn("_r", T.normalized_range(F.col("origin"), F.col("start"), F.col("end"))).where("_r IS NOT NULL").withColumn("low", F.col("_r.start").cast("long")).withColumn("high", F.col("_r.end").cast("long")).drop("_r")
    rows = rows.join(corpus, "doc").withColumn("repeated", labels.is_repeated(F.col("corpus"), F.col("norm_marked"), F.col("norm_before"), F.col("norm_after"))).drop("corpus", "norm_marked", "norm_before", "norm_after")
    return rows.withColumn("hid", F.concat_ws(":", "pid", "highlight")).withColumn("length", F.col("high") - F.col("low"))


def widened(rows: DataFrame, radius: int) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), F.col("low") - radius), F.least(F.col("size"), F.col("high") + radius)


def heard(marks: DataFrame, tracks: DataFrame, asr: Aligner | None) -> tuple[DataFrame, DataFrame]:
    """(marks, tracks): located marks with the range of the whole audio's track, that of a recognition about it, and the context
    there is for them; and the tracks of these recognitions."""
    doc = F.col("doc").cast("string")
    found = marks.where("located")
    coarse = ranges(wanted(found, doc, "hid", F.col("base") + F.col("low"), F.col("base") + F.col("high"), gap=GAP), tracks)
    a, b = widened(found, refine.CONTEXT)
    about = ranges(wanted(found, doc, "hid", F.col("base") + a, F.col("base") + b), tracks)
    rows = found.join(prefixed(coarse, "id", "whole").withColumnRenamed("id", "hid"), "hid", "left").join(about.select(F.col("id").alias("hid"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e")), "hid", "left")
    even = labels.proportional(F.col("size"), F.col("low"), F.col("high"), F.col("seen_start_ms"), F.col("seen_end_ms"))
    s, e = F.coalesce("whole_start_ms", "_s", even["start"]), F.coalesce("whole_end_ms", "_e", even["end"])
    window = padded(s, e, refine.AROUND, F.col("last_ms"))
    rows = stored(rows.withColumn("_from", window[0]).withColumn("_to", window[1]).drop("_s", "_e"), "marks")
    local = stored(invoked(requests(rows.where("_to > _from"), "hid", "text", REFINEMENT, "_from", "_to"), asr, "track"), "refined-tracks")
    own = ranges(wanted(rows, "hid", "hid", F.col("low"), F.col("high"), gap=GAP), local)
    seen = ranges(wanted(rows, "hid", "hid", *widened(rows, refine.CONTEXT)), local).where(F.col("coverage") >= CONTEXT_SEEN)
    rows = rows.join(prefixed(own, "id", "near").withColumnRenamed("id", "hid"), "hid", "left").join(seen.select(F.col("id").alias("hid"), F.lit(True).alias("_near")), "hid", "left")
    rows = rows.withColumn("local", F.coalesce(F.col("near_coverage") >= scoring.MIN_ASR, F.lit(False)))
    rows = rows.withColumn("context", F.when(F.col("_near"), F.col("hid")).otherwise(doc)).withColumn("context_base", F.when(F.col("_near"), F.lit(0)).otherwise(F.col("base"))).drop("_near", "_from", "_to")
    both = tracks.unionByName(local)
    sides = {"left": (F.greatest(F.lit(0), F.col("low") - BESIDE), F.col("low")), "right": (F.col("high"), F.least(F.col("size"), F.col("high") + BESIDE))}
    available, supported = F.lit(0), F.lit(0.0)
    for name, (a, b) in sides.items():
        told = ranges(wanted(rows, "context", "hid", F.col("context_base") + a, F.col("context_base") + b), both)
        rows = rows.join(told.select(F.col("id").alias("hid"), F.col("coverage").alias(f"_{name}")), "hid", "left")
        available, supported = available + (b - a), supported + (b - a) * F.coalesce(F.col(f"_{name}"), F.lit(0.0))
    rows = rows.withColumn("weak_context", ~refine.is_supported(available, supported + 1e-9)).drop(*[f"_{n}" for n in sides])
    return stored(rows, "heard"), both


def excerpts(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """hid, radius, eid, audio, excerpt, target [low, high), first_ms, last_ms: what is to be aligned about each mark; the same
    excerpt in the same window only once."""
    each = rows.withColumn("radius", F.explode(F.array(*map(F.lit, RADII))))
    left, right = F.greatest(F.lit(0), F.col("low") - F.col("radius")), F.least(F.col("size"), F.col("high") + F.col("radius"))
    each = each.withColumn("eid", F.concat_ws(":", "hid", "radius")).withColumn("_l", left.cast("int")).withColumn("_r", right.cast("int")).where("_r > _l")
    seen = ranges(wanted(each, "context", "eid", F.col("context_base") + F.col("_l"), F.col("context_base") + F.col("_r")), tracks).where(F.col("coverage") >= EXCERPT_SEEN)
    each = each.join(seen.select(F.col("id").alias("eid"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e")), "eid")
    window = padded(F.col("_s"), F.col("_e"), EXCERPT_PAD, F.col("last_ms"))
    origin = lambda i: F.get("origin", i.cast("int"))
    first_at = lambda x: F.array_position("origin", x) - 1
    last_at = lambda x: F.size("origin") - F.array_position(F.reverse("origin"), x)
    a, b = origin(F.col("_l")), origin(F.col("_r") - 1) + 1
    each = each.select(
        "hid", "radius", "eid", "audio", F.substring("text", a + 1, b - a).alias("excerpt"), (first_at(origin(F.col("low"))) - first_at(a)).alias("target_low"), (last_at(origin(F.col("high") - 1)) + 1 - first_at(a)).alias("target_high"),
        window[0].alias("from_ms"), window[1].alias("to_ms"),
    ).where("to_ms > from_ms")
    nth = F.row_number().over(Window.partitionBy("hid", "excerpt", "from_ms", "to_ms").orderBy("radius"))
    return each.withColumn("_n", nth).where("_n = 1").drop("_n")


def track_facts(tracks: DataFrame) -> DataFrame:
    return tracks.select("track", F.lit(True).alias("asr_there"), F.col("valid").alias("asr_track_valid"), F.array_contains("diagnostics", "dp_forced_partition").alias("split"), F.col("diagnostics").alias("asr_track_diagnostics"))


#: What the evidence calls what track_ranges says.
EVIDENCE = {"start": "start_ms", "end": "end_ms", "coverage": "coverage", "mean": "mean_confidence", "min": "min_confidence", "low": "low_share", "precision": "precision", "margin": "margin", "valid": "valid", "confidence_coverage": "confidence_coverage", "voice_start": "voice_start", "voice_end": "voice_end"}


def evidence_of(df: DataFrame, key: str, engine: str) -> DataFrame:
    return df.select(F.col(key), *[F.col(of).alias(f"{engine}_{name}") for name, of in EVIDENCE.items()])


def candidates(paragraphs: DataFrame, highlights: DataFrame, audio: DataFrame, asr: Aligner | None = None, force: Aligner | None = None) -> DataFrame:
    """A judged candidate for each mark that holds a letter.

    paragraphs: doc, paragraph, anchor_ms, text; highlights: doc, paragraph, highlight, start, end (in
    the paragraph's text), text, before, after; audio: doc, audio, sample_rate, total_samples.
    asr and force are the plug-ins (see :func:`spanloom.operators.tracks.invoked`).

    Gives doc, paragraph, highlight, text, start, end (samples), confidence, reasons, status,
    review_required, left_guard, right_guard, vad_start, vad_end, diagnostics.
    """
    rows, whole = located(paragraphs, audio, asr)
    rows = stored(rows, "located")
    marks = stored(placed(highlights, rows), "placed")
    lost = rows.where("NOT located").join(marks.select("pid").distinct(), "pid", "left_semi")
    anchor = stored(invoked(requests(lost, "pid", "text", ANCHOR_ASR, "from_ms", "to_ms"), asr, "track"), "anchor-tracks")
    anchor_force = stored(invoked(requests(lost, "pid", "text", ANCHOR_FORCE, "from_ms", "to_ms"), force, "track"), "anchor-force-tracks")
    near, both = heard(marks, whole, asr)
    asks = stored(excerpts(near, both), "excerpts")
    forced = stored(invoked(requests(asks, "eid", "excerpt", F.concat_ws("-", F.lit(EXCERPT), "radius"), "from_ms", "to_ms"), force, "track"), "force-tracks")

    told = ranges(wanted(asks, "eid", "eid", F.col("target_low"), F.col("target_high"), cap=True, gap=GAP), forced)
    agreed = refine.consensus(told.join(asks.select(F.col("eid").alias("id"), "hid", "radius"), "id"), ["hid"], "radius")
    there = asks.join(forced.select(F.col("track").alias("eid")), "eid").select("hid", F.lit(True).alias("force_there")).distinct()
    doc = F.col("doc").cast("string")
    near_asr = [F.coalesce(F.when(F.col("near_start_ms").isNotNull(), F.col(f"near_{c}")), F.when(F.col("near_start_ms").isNull(), F.col(f"whole_{c}"))).alias(f"asr_{n}") for n, c in EVIDENCE.items()]
    found = near.select(*marks.columns, "local", "weak_context", *near_asr, F.when(F.col("local"), F.col("hid")).otherwise(doc).alias("active"), F.when(F.col("local"), F.lit(0)).otherwise(F.col("base")).alias("active_base"))
    found = found.join(evidence_of(agreed, "hid", "force"), "hid", "left").join(agreed.select("hid", "unstable", "consensus"), "hid", "left").join(there, "hid", "left")

    rest = marks.where("NOT located")
    beside = rest.join(evidence_of(ranges(wanted(rest, "pid", "hid", F.col("low"), F.col("high"), cap=True, gap=GAP), anchor), "id", "asr").withColumnRenamed("id", "hid"), "hid", "left")
    beside = beside.join(evidence_of(ranges(wanted(rest, "pid", "hid", F.col("low"), F.col("high"), cap=True, gap=GAP), anchor_force), "id", "force").withColumnRenamed("id", "hid"), "hid", "left")
    beside = beside.join(anchor_force.select(F.col("track").alias("pid"), F.lit(True).alias("force_there")), "pid", "left")
    beside = beside.withColumns({"local": F.lit(False), "weak_context": F.lit(False), "active": F.col("pid"), "active_base": F.lit(0), "unstable": F.lit(False), "consensus": F.lit(False)})

    every = both.unionByName(anchor)
    rows = stored(found.unionByName(beside.select(*found.columns)), "evidence")
    sides = range_guards(rows.select(F.col("active").alias("track"), F.col("hid").alias("id"), (F.col("active_base") + F.col("low")).alias("low"), (F.col("active_base") + F.col("high")).alias("high")), every, "track", "id")
    rows = rows.join(sides.withColumnRenamed("id", "hid"), "hid", "left").join(track_facts(every).withColumnRenamed("track", "active"), "active", "left")
    return finished(rows, force is not None)


def finished(rows: DataFrame, force_given: bool) -> DataFrame:
    """The rows of evidence judged, in samples, with the record of what the judgement rests on."""
    rate, total = F.col("sample_rate"), F.col("total_samples")
    even = labels.proportional(F.col("size"), F.col("low"), F.col("high"), F.coalesce("seen_start_ms", "core_start"), F.coalesce("seen_end_ms", "core_end"))
    rows = rows.withColumns({"proportional_start": even["start"], "proportional_end": even["end"], "force_given": F.lit(force_given)})
    rows = scoring.fused(rows, F.col("duration_ms")).withColumn("_r", T.sample_range(F.col("start_ms"), F.col("end_ms"), rate, total)).withColumn("sample_start", F.col("_r.start")).withColumn("sample_end", F.col("_r.end"))
    left, right = T.sample_at(F.col("left_ms"), rate, total), T.sample_at(F.col("right_ms"), rate, total)
    rows = rows.withColumn("left_guard", F.when(left < F.col("sample_end"), left)).withColumn("right_guard", F.when(right > F.col("sample_start"), right))
    rows = scoring.recorded(scoring.approved(scoring.reasons(scoring.confidence(scoring.flags(rows)))))
    more = F.col("diagnostics").withField("source_highlight_index", F.col("highlight")).withField("initial_start_sample", F.col("sample_start")).withField("initial_end_sample", F.col("sample_end")).withField("asr_track_diagnostics", F.coalesce("asr_track_diagnostics", F.array().cast("array<string>")))
    status = F.when(F.col("auto"), "auto_approved").otherwise("needs_review")
    return rows.select(
        "doc", "paragraph", "highlight", F.col("marked").alias("text"), F.col("sample_start").alias("start"), F.col("sample_end").alias("end"), "confidence", "reasons", status.alias("status"), (~F.col("auto")).alias("review_required"), "left_guard", "right_guard",
        T.sample_at(F.col("asr_voice_start"), rate, total).alias("vad_start"), T.sample_at(F.col("asr_voice_end"), rate, total).alias("vad_end"), more.alias("diagnostics"),
    )


__all__ = ["TRACK", "candidates", "excerpts", "finished", "heard", "located", "placed"]
