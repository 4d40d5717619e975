"""Queries of recognised speech: tracks, their ranges and guards, voice ranges, plug-in calls and candidates."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as T
from spanloom.operators import align, tracks
from spanloom.operators import candidates as C
from spanloom.plans.carriers import TOKENS, table, tokens
from spanloom.plans.catalogue import NORM, gram_texts, query, rounded

#: Spans of a user: a position for each token, in groups of seven with a pause between.
SPANS = f"""{TOKENS}, sp AS (SELECT user_id, event_id, t AS a, t + 1 AS b, t * 100.0::DOUBLE + t // 7 * 2000 + event_id % 4 * 10 AS start_ms, t * 100.0::DOUBLE + t // 7 * 2000 + event_id % 4 * 10 + 80 + event_id % 5 * 10 AS end_ms, confidence, precision, (event_id % 10) / 10.0::DOUBLE AS margin
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1 AS t FROM tokens)),
  vo AS (SELECT user_id, min(start_ms) AS vs, max(end_ms) AS ve FROM sp GROUP BY user_id, a // 7)"""


def spans(spark, sf_dir):
    t, k = F.col("t"), F.col("event_id")
    rows = tokens(spark, sf_dir).withColumn("t", (F.row_number().over(Window.partitionBy("user_id").orderBy("start", "event_id")) - 1).cast("long"))
    start = t * 100.0 + F.floor(t / 7) * 2000 + k % 4 * 10
    return rows.select("user_id", k, t.alias("a"), (t + 1).alias("b"), start.alias("start_ms"), (start + 80 + k % 5 * 10).alias("end_ms"), F.lit(1.0).alias("confidence"), F.col("confidence").alias("model_confidence"), "precision", ((k % 10) / F.lit(10.0)).alias("margin"))


def user_tracks(spark, sf_dir):
    rows = spans(spark, sf_dir)
    span = F.struct(*tracks.SPAN.names)
    voice = rows.groupBy("user_id", F.floor(F.col("a") / 7).alias("_g")).agg(F.min("start_ms").alias("start"), F.max("end_ms").alias("end")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("voice"))
    held = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(span)).alias("spans")).join(voice, "user_id")
    none = F.lit(None).cast("double")
    told = {"engine": F.lit("made"), "coverage": F.lit(0.9), "mean_confidence": none, "min_confidence": none, "low_share": none, "precision": F.lit("unknown"), "valid": F.col("user_id") % 7 != 0, "margin": F.lit(1.0), "diagnostics": F.array().cast("array<string>"), "confidence_coverage": F.lit(0.0)}
    return held.select(F.col("user_id").alias("track"), *[c.alias(n) for n, c in told.items()], "voice", "spans")


@query(f"""WITH {SPANS}, w AS (SELECT user_id, event_id AS id, greatest(a - 2, 0) AS low, a + 4 AS high, event_id % 2 = 0 AS cap, CASE WHEN event_id % 3 > 0 THEN 1500 END AS most FROM sp),
  m AS (SELECT w.*, sp.a, start_ms, end_ms, confidence, precision, margin FROM w JOIN sp ON sp.user_id = w.user_id AND sp.a >= w.low AND sp.a < w.high),
  g AS (SELECT *, start_ms - max(end_ms) OVER (PARTITION BY id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM m),
  r AS (SELECT user_id, id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) / max(high - low)::DOUBLE AS own, max(cap::INT) AS cap, avg(confidence) AS mean_confidence, min(confidence) AS min_confidence, count(*) FILTER (confidence < 0.5) / nullif(count(confidence), 0)::DOUBLE AS low_share,
    (['character', 'token', 'segment'])[max(list_position(['character', 'token', 'segment'], precision))] AS precision, min(margin) AS margin, count(confidence) / count(*)::DOUBLE AS confidence_coverage FROM g GROUP BY user_id, id HAVING max(most) IS NULL OR coalesce(max(gap), 0) <= max(most))
  SELECT r.id, r.start_ms, r.end_ms, round(CASE WHEN cap = 1 THEN least(own, 0.9::DOUBLE) ELSE own END, 6) AS coverage, round(mean_confidence, 6) AS mean_confidence, min_confidence, round(low_share, 6) AS low_share, precision, margin, user_id % 7 <> 0 AS valid, round(confidence_coverage, 6) AS confidence_coverage,
    (SELECT min(vs) FROM vo WHERE vo.user_id = r.user_id AND ve >= r.start_ms AND vs <= r.end_ms) AS voice_start, (SELECT max(ve) FROM vo WHERE vo.user_id = r.user_id AND ve >= r.start_ms AND vs <= r.end_ms) AS voice_end FROM r""")
def track_ranges(spark, sf_dir):
    a, k = F.col("a"), F.col("event_id")
    asks = spans(spark, sf_dir).select(F.col("user_id").alias("track"), k.alias("id"), F.greatest(a - 2, F.lit(0)).cast("long").alias("low"), (a + 4).alias("high"), (k % 2 == 0).alias("cap"), F.when(k % 3 > 0, 1500.0).alias("max_gap_ms"))
    return rounded(tracks.track_ranges(asks, user_tracks(spark, sf_dir), "track", "id", 16), "coverage", "mean_confidence", "low_share", "confidence_coverage")


@query(f"""WITH {SPANS}, w AS (SELECT user_id, event_id AS id, a AS low, a + 3 AS high FROM sp), g AS (SELECT w.id, max(l.end_ms) AS l, (SELECT min(start_ms) FROM sp r WHERE r.user_id = w.user_id AND r.a >= w.high) AS r FROM w LEFT JOIN sp l ON l.user_id = w.user_id AND l.b <= w.low GROUP BY w.id, w.user_id, w.high)
  SELECT id, CASE WHEN NOT coalesce(r <= l, false) THEN l END AS left_ms, CASE WHEN NOT coalesce(r <= l, false) THEN r END AS right_ms FROM g""")
def range_guards(spark, sf_dir):
    asks = spans(spark, sf_dir).select(F.col("user_id").alias("track"), F.col("event_id").alias("id"), F.col("a").alias("low"), (F.col("a") + 3).alias("high"))
    return tracks.range_guards(asks, user_tracks(spark, sf_dir), "track", "id")


WORDS = rf"""wd AS (SELECT item_id, text, i, words[i] AS word, {NORM.replace("text", "words[i]")} AS norm, len(words) AS n FROM (SELECT item_id, text, regexp_extract_all(text, '\S+') AS words FROM benchmark), LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i))"""


def results(spark, sf_dir):
    """A raw result for each passage: its words, 200 ms each with a pause of 600 ms before each tenth, in seconds."""
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    start = lambda i: i * 0.2 + F.floor(i / 10) * 0.6
    times = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array(start(i), start(i) + 0.2))
    sure = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i % 10) / F.lit(10.0))
    rows = table(spark, sf_dir, "benchmark").withColumn("w", words)
    raw = F.to_json(F.struct(F.array_join("w", " ").alias("text"), times.alias("timestamp"), sure.alias("scores")))
    return rows.select("item_id", raw.alias("raw"), F.col("text").alias("transcript"), F.lit("asr").alias("engine"), F.lit(False).alias("forced"), F.lit(True).alias("seconds"), F.lit(1000.0).alias("first_ms"), F.lit(None).cast("double").alias("last_ms"))


@query(f"""WITH {WORDS}, t AS (SELECT *, 1000 + (i - 1) * 200 + (i - 1) // 10 * 600 AS s FROM wd WHERE norm <> '')
  SELECT item_id, 1.0::DOUBLE AS coverage, CASE WHEN max(length(norm)) > 1 THEN 'token' ELSE 'character' END AS precision, CAST(sum(length(norm)) AS BIGINT) AS spans, true AS valid, CAST(min(s) AS DOUBLE) AS start_ms, CAST(max(s) + 200 AS DOUBLE) AS end_ms, count(*) FILTER (length(norm) = 1) / CAST(sum(length(norm)) AS DOUBLE) AS confidence_coverage,
    'timestamp_unit:seconds,matching_strategy:anchored_monotonic_dp,vad_ranges_unavailable' AS diagnostics FROM t GROUP BY item_id""")
def tracks_from_results(spark, sf_dir):
    found = tracks.tracks_from_results(results(spark, sf_dir), "item_id")
    told = found.select("item_id", "coverage", "precision", F.size("spans").cast("long").alias("spans"), "valid", F.array_min(F.transform("spans", lambda s: s["start_ms"])).alias("start_ms"), F.array_max(F.transform("spans", lambda s: s["end_ms"])).alias("end_ms"), "confidence_coverage", F.array_join("diagnostics", ",").alias("diagnostics"))
    return rounded(told, "start_ms", "end_ms")


@query(f"""WITH {WORDS} SELECT item_id, i AS word, j AS nth, norm[j] AS letter, round(1000 + (i - 1) * 200 + (i - 1) // 10 * 600, 6)::DOUBLE AS start_ms, CASE WHEN length(norm) = 1 THEN 'character' ELSE 'token' END AS precision, length(norm) = 1 AS confidence_available FROM wd, LATERAL (SELECT unnest(range(1, length(norm) + 1)) AS j)""")
def recognition_tokens(spark, sf_dir):
    rows = rounded(tracks.tokens_from_results(results(spark, sf_dir), "item_id"), "start_ms")
    n = F.round((F.col("start_ms") - 1000) / 200).cast("long")
    word = n - F.floor(n / 13) * 3 + 1
    nth = F.row_number().over(Window.partitionBy("item_id", "start_ms").orderBy("position"))
    return rows.select("item_id", word.alias("word"), nth.cast("long").alias("nth"), F.col("text").alias("letter"), "start_ms", "precision", "confidence_available")


@query(f"""WITH {TOKENS}, v AS (SELECT user_id, event_id, event_id * 500.0::DOUBLE AS s, event_id * 500.0::DOUBLE + 100 + event_id % 7 * 80 AS e FROM tokens),
  f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 1 ELSE 0 END AS new FROM v), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f)
  SELECT user_id, min(s) AS start, max(e) AS "end" FROM g GROUP BY user_id, island""")
def voice_ranges(spark, sf_dir):
    k = F.col("event_id")
    pair = F.array(k * 500.0, k * 500.0 + 100 + k % 7 * 80)
    rows = tokens(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(k % 2 == 0, pair))).alias("vad"), F.array_sort(F.collect_list(F.when(k % 2 != 0, F.struct(pair[0].alias("start"), pair[1].alias("end"))))).alias("sentence_info"))
    raw = rows.select("user_id", F.to_json(F.struct("vad", "sentence_info")).alias("raw"), F.lit(False).alias("seconds"), F.lit(0.0).alias("first_ms"), F.lit(None).cast("double").alias("last_ms"))
    return tracks.voice_ranges(raw, "user_id")


@query()
def alignment_margin(spark, sf_dir):
    """The margin of each passage aligned to itself without each seventh letter, and how many positions have a competing way."""
    return align.alignment_margins(gram_texts(spark, sf_dir), "item_id").select("item_id", "matches", F.round("margin", 6).alias("margin"), "split", F.size("unsure").cast("long").alias("unsure"))


def made_aligner(audio, transcript, first, last):
    """A plug-in that answers by the name of the audio: half of the text, nothing, or what breaks."""
    kind = audio.rpartition("/")[2]
    if kind == "gone":
        raise tracks.Unavailable
    if kind == "odd":
        raise RuntimeError(kind)
    n = len(tracks.plain(transcript))
    return [{"normalized_start": k, "normalized_end": k + 1, "start_ms": first + 10 * k, "end_ms": first + 10 * k + (10 if kind == "fine" else -10)} for k in range(n // 2)]


@query(f"""WITH r AS (SELECT item_id, length({NORM}) AS n, (['fine', 'gone', 'odd', 'bad'])[item_id % 4 + 1] AS kind FROM benchmark)
  SELECT item_id, CASE WHEN kind = 'fine' THEN round(n // 2 / n::DOUBLE, 6) ELSE 0.0::DOUBLE END AS coverage, kind = 'fine' OR n < 2 AS valid, CASE WHEN kind = 'fine' OR n < 2 THEN '' ELSE 'aligner_result_rejected:ValueError' END AS diagnostics FROM r WHERE kind IN ('fine', 'bad')""")
def aligner_calls(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("fine", "gone", "odd", "bad"))), (F.col("item_id") % 4 + 1).cast("int"))
    asks = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("/a/"), kind).alias("audio"), F.col("text").alias("transcript"), F.lit("made").alias("engine"), F.lit(0.0).alias("first_ms"), F.lit(1e9).alias("last_ms"))
    found = tracks.invoked(asks, made_aligner, "item_id")
    return found.select("item_id", F.round("coverage", 6).alias("coverage"), "valid", F.array_join("diagnostics", ",").alias("diagnostics"))


#: A passage's letters are spoken 100 ms each; the third word of each is marked.
SAID = rf"""sd AS (SELECT item_id, text, {NORM} AS norm, regexp_extract(text, '^(\S+\s+\S+\s+)', 1) AS before, regexp_extract(text, '^\S+\s+\S+\s+(\S+)', 1) AS mark FROM benchmark)"""


def speaker(audio, transcript, first, last):
    """A recogniser of made audio, whose name holds the letters that are spoken, 100 ms each from 1000 ms on."""
    said = json.loads(audio)
    heard = [k for k in range(len(said)) if 1000 + 100 * k >= first and 1100 + 100 * k <= last]
    if not heard:
        raise tracks.Unavailable
    result = {"tokens": [said[k] for k in heard], "timestamp": [[1000 + 100 * k - first, 1100 + 100 * k - first] for k in heard], "scores": [0.95] * len(heard)}
    return tracks.track_of(result, transcript, "made", first=first, last=last)


@query(f"""WITH {SAID}, p AS (SELECT item_id, mark, length({NORM.replace("text", "before")}) AS low, length({NORM.replace("text", "mark")}) AS len FROM sd)
  SELECT item_id AS doc, mark AS text, CAST((1000 + low * 100) * 16 AS BIGINT) AS start, CAST((1000 + (low + len) * 100) * 16 AS BIGINT) AS "end" FROM p WHERE len > 0""")
def candidates(spark, sf_dir):
    """Candidates of every passage, by the whole pipeline with a plug-in for recogniser and aligner."""
    rows = table(spark, sf_dir, "benchmark").withColumn("norm", T.normalized(F.col("text"))).withColumn("before", F.regexp_extract("text", r"^(\S+\s+\S+\s+)", 1)).withColumn("mark", F.regexp_extract("text", r"^\S+\s+\S+\s+(\S+)", 1))
    paragraphs = rows.select(F.col("item_id").alias("doc"), F.lit(0).cast("long").alias("paragraph"), F.lit(1000).cast("long").alias("anchor_ms"), "text")
    start = F.length("before").cast("long")
    marks = rows.where("mark <> ''").select(F.col("item_id").alias("doc"), F.lit(0).cast("long").alias("paragraph"), F.lit(0).cast("long").alias("highlight"), start.alias("start"), (start + F.length("mark")).alias("end"), F.col("mark").alias("text"), F.right("before", F.lit(12)).alias("before"), F.substring("text", start + F.length("mark") + 1, F.lit(12)).alias("after"))
    audio = rows.select(F.col("item_id").alias("doc"), F.to_json(F.split("norm", "")).alias("audio"), F.lit(16_000).cast("long").alias("sample_rate"), ((F.length("norm") * 100 + 3000) * 16).cast("long").alias("total_samples"))
    return C.candidates(paragraphs, marks, audio, speaker, speaker).select("doc", "text", "start", "end")


