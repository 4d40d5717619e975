"""Queries of small functions and sequences: texts, clocks, names, views, marks, lines and samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import labels
from spanloom.functions import text as T
from spanloom.operators import markup, projects, segments, signals
from spanloom.plans.carriers import CUTS, EVIDENCE, SCORED, SIGNAL, TOKENS, cuts, signal, table, tokens
from spanloom.plans.catalogue import BASE, HOUR, NORM, RUNS, STEREO, candidates, highlight_runs, judged, query, rounded, stereo

SHORT = f"""nr AS (SELECT conv_id, turn, text, {NORM} AS norm, turn % 5 AS a, turn % 5 + 7 AS b FROM conversations)"""


@query(f"""WITH {SHORT}, c AS (SELECT conv_id, turn, a, b, length({NORM.replace("text", "left(text, a)")}) AS l, length({NORM.replace("text", "left(text, b)")}) AS r FROM nr)
  SELECT conv_id, turn, CASE WHEN r > l THEN l END AS start, CASE WHEN r > l THEN r END AS "end" FROM c""")
def normalized_ranges(spark, sf_dir):
    a = F.col("turn") % 5
    rows = T.normalized_any(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text")
    return rows.select("conv_id", "turn", T.normalized_range(F.col("origin"), a, a + 7).alias("r")).select("conv_id", "turn", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))


@query("SELECT p_partkey, chr(CAST(13290 + p_partkey * 7 % 50000 AS INT)) AS letter, (13290 + p_partkey * 7 % 50000) BETWEEN 13312 AND 19903 OR (13290 + p_partkey * 7 % 50000) BETWEEN 19968 AND 40959 OR (13290 + p_partkey * 7 % 50000) BETWEEN 63744 AND 64255 AS han FROM part WHERE NOT (13290 + p_partkey * 7 % 50000) BETWEEN 55296 AND 57343")
def han_letters(spark, sf_dir):
    code = 13290 + F.col("p_partkey") * 7 % 50000
    raw = F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0"))
    rows = table(spark, sf_dir, "part").where(~code.between(55296, 57343)).select("p_partkey", F.decode(raw, "UTF-16BE").alias("letter"))
    return rows.select("p_partkey", "letter", T.is_han(F.col("letter")).alias("han"))


@query("SELECT event_id, letter, CASE WHEN letter IN ('a', 'e', 'i') THEN 'sound:vowel' ELSE 'literal:' || letter END AS key FROM (SELECT event_id, left(event_type, 1) AS letter FROM events)")
def phonetic_keys(spark, sf_dir):
    sounds = spark.sql("SELECT letter, 'vowel' AS sound FROM VALUES ('a'), ('e'), ('i') AS t(letter)")
    return T.phonetic_keys(table(spark, sf_dir, "events").select("event_id", F.left("event_type", F.lit(1)).alias("letter")), sounds).select("event_id", "letter", "key")


@query("SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', '', 'g')) AS plain_sha256 FROM pages")
def tag_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.without_tags(F.col("html")), 256).alias("plain_sha256"))


@query("""SELECT conv_id, turn, substring(text, greatest(a - 10, 0) + 1, least(a + 13, length(text)) - greatest(a - 10, 0)) AS excerpt, a - greatest(a - 10, 0) AS start, a + 3 - greatest(a - 10, 0) AS "end" FROM (SELECT *, least(turn * 3, greatest(length(text) - 3, 0)) AS a FROM conversations)""")
def context_excerpts(spark, sf_dir):
    a = F.least(F.col("turn") * 3, F.greatest(F.length("text") - 3, F.lit(0)))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", labels.excerpt(F.col("text"), a, a + 3, 10).alias("e"))
    return rows.select("conv_id", "turn", F.col("e.text").alias("excerpt"), "e.start", "e.end")


@query("""SELECT event_id, event_type || ' x' AS token, event_id * 1.5::DOUBLE AS start, event_id + 2.0::DOUBLE AS "end" FROM events WHERE event_id % 3 <> 0""")
def serialized_tokens(spark, sf_dir):
    k = F.col("event_id")
    text = F.concat(F.when(k % 3 == 0, "a b;").otherwise(F.concat("event_type", F.lit(" x "), (k * 1.5).cast("string"), F.lit(" "), (k + 2).cast("string"), F.lit("; "))), F.lit(" 12;"))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(T.serialized_tokens(text)).alias("t"))
    return rows.select("event_id", "t.token", "t.start", "t.end")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.25::DOUBLE WHEN 2 THEN 1.0::DOUBLE WHEN 4 THEN 0.75::DOUBLE END AS confidence FROM events")
def token_confidences(spark, sf_dir):
    k = F.col("event_id") % 6
    raw = F.when(k == 0, '{"prob": 0.1, "confidence": 0.5}').when(k == 1, '{"confidence": 2, "score": 0.25}').when(k == 2, '{"probability": 1}').when(k == 3, '{"score": true}').when(k == 4, '{"score": "0.75"}').otherwise("[]")
    return table(spark, sf_dir, "events").select("event_id", T.confidence_of(raw).alias("confidence"))


@query("SELECT o_orderkey, o_orderkey * 997 * 1000 // 44100 AS duration_ms, round(o_orderkey * 997 / 44100.0::DOUBLE, 9) AS duration_seconds FROM orders")
def durations(spark, sf_dir):
    samples = F.col("o_orderkey").cast("long") * 997
    return table(spark, sf_dir, "orders").select("o_orderkey", T.duration_ms(samples, F.lit(44100)).alias("duration_ms"), F.round(samples / 44100.0, 9).alias("duration_seconds"))


@query("""WITH m AS (SELECT o_orderkey, CAST(o_orderkey * 7919 % 90000000 AS BIGINT) AS ms FROM orders) SELECT o_orderkey, printf('%02d:%02d:%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) AS long, printf('%d:%02d.%03d', ms // 60000, ms // 1000 % 60, ms % 1000) AS short FROM m""")
def clocks(spark, sf_dir):
    ms = (F.col("o_orderkey") * 7919 % 90000000).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.clock(ms).alias("long"), labels.clock_ms(ms).alias("short"))


@query("SELECT event_id, event_id % 4 IN (0, 1) AS valid FROM events")
def iso_times(spark, sf_dir):
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(day, F.lit("Z"))).when(k == 1, F.concat(day, F.lit("+02:00"))).when(k == 2, day).otherwise(F.concat(F.lit("2024-13-01T00:00:00"), F.lit("Z")))
    return table(spark, sf_dir, "events").select("event_id", labels.iso_with_zone(text).alias("valid"))


@query(f"WITH {EVIDENCE}, {SCORED} SELECT reason, CASE reason WHEN 'short_highlight' THEN 'Short' ELSE replace(reason, '_', ' ') END AS label FROM (SELECT DISTINCT unnest(reasons) AS reason FROM scored)")
def reason_labels(spark, sf_dir):
    rows = judged(spark, sf_dir).select(F.explode("reasons").alias("reason")).distinct()
    return rows.select("reason", labels.reason_label(F.col("reason"), {"short_highlight": "Short"}).alias("label"))


@query("""SELECT o_orderkey, left(sha256('["' || o_custkey || '","' || o_orderstatus || '"]'), 12) AS key FROM orders""")
def preview_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.state_key(F.col("o_custkey"), F.col("o_orderstatus")).alias("key"))


@query("""SELECT page_id, '/d.x/name.' || page_id || CASE page_id % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.MP3' ELSE '.txt' END AS path, 'name.' || page_id || '_cut.wav' AS name, page_id % 3 < 2 AS audio FROM pages""")
def output_names(spark, sf_dir):
    k = F.col("page_id")
    path = F.concat(F.lit("/d.x/name."), k.cast("string"), F.when(k % 3 == 0, ".wav").when(k % 3 == 1, ".MP3").otherwise(".txt"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), labels.output_name(path, "_cut.wav").alias("name"), labels.is_audio(path).alias("audio"))


@query(f"""WITH {CUTS} SELECT o_orderkey, round(least(greatest((s - 100) * 800 / greatest(e - 100, 1)::DOUBLE, 0), 800), 9) AS pixel, CAST(least(greatest(CAST(100 + round_even(300 * (greatest(e, 101) - 100) / 800.0::DOUBLE, 0) AS BIGINT), 100), greatest(e, 101)) AS BIGINT) AS sample FROM cuts""")
def pixel_mapping(spark, sf_dir):
    first = F.lit(100).cast("long")
    return cuts(spark, sf_dir).select("o_orderkey", F.round(labels.sample_to_pixel(F.col("start"), first, F.col("end"), 800), 9).alias("pixel"), labels.pixel_to_sample(F.lit(300.0), first, F.greatest("end", F.lit(101)).cast("long"), 800).alias("sample"))


@query("""WITH v AS (SELECT o_orderkey, o_orderkey % 1000 AS a, o_orderkey % 1000 + 50 + o_orderkey % 400 AS b FROM orders), w AS (SELECT *, least(greatest((b - a) * 0.5::DOUBLE, 100), 2000) AS wide, a + 20 AS mid FROM v)
  SELECT o_orderkey, CAST(floor(least(greatest(mid - (mid - a) * wide / greatest(b - a, 1), 0), 2000 - wide)) AS BIGINT) AS first, CAST(floor(least(greatest(mid - (mid - a) * wide / greatest(b - a, 1), 0), 2000 - wide)) + floor(wide) AS BIGINT) AS last FROM w""")
def zoomed_views(spark, sf_dir):
    a = F.col("o_orderkey") % 1000
    b = a + 50 + F.col("o_orderkey") % 400
    rows = table(spark, sf_dir, "orders").select("o_orderkey", labels.zoomed(a, b, a + 20, 0.5, F.lit(2000), 100).alias("v"))
    return rows.select("o_orderkey", F.col("v.first").cast("long").alias("first"), F.col("v.last").cast("long").alias("last"))


@query("""WITH p AS (SELECT doc_id, text, doc_id % 50 AS after FROM documents), m AS (SELECT *, instr(substring(text, after + 1), 'the') AS ahead FROM p) SELECT doc_id, CAST(CASE WHEN ahead > 0 THEN after + ahead - 1 ELSE instr(text, 'the') - 1 END AS BIGINT) AS position FROM m""")
def next_matches(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", labels.next_match(F.col("text"), "the", F.col("doc_id") % 50).cast("long").alias("position"))


@query("""SELECT doc_id AS id, doc_id % 20 + 1 AS paragraph, printf('%.3f - %.3f', doc_id / 1000.0, (doc_id + 500) / 1000.0) AS time, (doc_id % 100) || '%' AS percent, CASE WHEN toxic = 1 THEN 'Skipped' WHEN quality = 1 THEN 'auto_approved' ELSE 'needs_review' END AS label, 'short highlight, b' AS reasons FROM labels""")
def review_table(spark, sf_dir):
    rows = candidates(spark, sf_dir).select("id", (F.col("id") % 20).alias("paragraph"), F.col("id").alias("start_ms"), (F.col("id") + 500).alias("end_ms"), (F.col("id") % 100 / F.lit(100.0)).alias("confidence"), "status", F.array(F.lit("short_highlight"), F.lit("b")).alias("reasons"))
    return projects.table_rows(rows, {"skipped": "Skipped"})


@query(r"""WITH l AS (SELECT conv_id, turn, i - 1 AS pos, letters[i] AS letter FROM (SELECT conv_id, turn, string_split(replace(text, ' ', chr(10)), '') AS letters FROM conversations), LATERAL (SELECT unnest(range(1, len(letters) + 1)) AS i))
  SELECT conv_id, turn, pos, CAST(coalesce(sum(CASE WHEN letter = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM l""")
def line_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.replace("text", F.lit(" "), F.lit("\n")), "")).alias("pos", "letter"))
    return projects.line_numbers(rows, ["conv_id", "turn"]).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "segment")


@query(f"""WITH {TOKENS}, v AS (SELECT user_id, event_id, value * 10 AS a, value * 10 + event_id % 90 AS b FROM tokens), m AS (SELECT *, max(a) OVER w AS ma, max(b) OVER w AS mb FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id FROM m WHERE a < ma - 5 OR b < mb - 5""")
def backward_spans(spark, sf_dir):
    rows = tokens(spark, sf_dir).select("user_id", "event_id", (F.col("value") * 10).alias("start"), (F.col("value") * 10 + F.col("event_id") % 90).alias("end"))
    return projects.not_monotone(rows, ["user_id"], ["event_id"], 5.0).select("event_id")


@query(f"WITH {RUNS} SELECT conv_id, turn, count(*) AS highlights, CAST(sum(e - s) AS BIGINT) AS characters FROM hl GROUP BY ALL")
def highlight_rollup(spark, sf_dir):
    return markup.rolled_up(highlight_runs(spark, sf_dir), ["conv_id", "turn"])


@query(r"""WITH m AS (SELECT conv_id, turn, i, marks[i] AS text FROM (SELECT conv_id, turn, regexp_extract_all(text, '[.,;!?]+|\s+|\w+') AS marks FROM conversations), LATERAL (SELECT unnest(range(1, len(marks) + 1)) AS i))
  SELECT conv_id, turn, i - 1 AS index, text, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'blank_highlight' ELSE 'punctuation_only_highlight' END AS reason FROM m WHERE length(regexp_replace(text, '[\p{P}\p{S}\p{C}\p{Z}\s]', '', 'g')) = 0""")
def skipped_highlights(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"[.,;!?]+|\s+|\w+"), F.lit(0))).alias("start", "text")).withColumn("end", F.col("start") + 1)
    return markup.skipped_report(rows, ["conv_id", "turn"]).select("conv_id", "turn", "index", "text", "reason")


@query("""WITH b AS (SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM conversations) SELECT conv_id, turn, CAST(base + 1 AS BIGINT) AS start, CAST(base + 4 AS BIGINT) AS "end" FROM b""")
def shifted_highlights(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    marks = rows.select("conv_id", "turn", F.lit(1).cast("long").alias("start"), F.lit(4).cast("long").alias("end"))
    return markup.shifted(marks, rows.select("conv_id", "turn", "text"), ["conv_id"], "turn").select("conv_id", "turn", "start", "end")


@query(f"""WITH {TOKENS}, f AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= {6 * HOUR} THEN 1 ELSE 0 END AS new FROM tokens),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM f), h AS (SELECT *, lag(seg) OVER (PARTITION BY user_id ORDER BY s, event_id) AS was FROM g),
  p AS (SELECT user_id, event_id, text, sum(length(CASE WHEN was IS NULL THEN '[' || seg || '] ' || text WHEN was <> seg THEN chr(10) || '[' || seg || '] ' || text ELSE text END)) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS e FROM h)
  SELECT event_id, CAST(e - length(text) AS BIGINT) AS "from", CAST(e AS BIGINT) AS "to" FROM p""")
def token_offsets(spark, sf_dir):
    rows = segments.by_gap(tokens(spark, sf_dir), ["user_id"], ["start", "event_id"], "start", "end", 6 * HOUR).withColumn("token", F.struct("start", "event_id"))
    return markup.token_offsets(rows, ["user_id"], F.col("segment").cast("string")).select("event_id", "from", "to")


@query(f"""WITH {CUTS} SELECT project, o_orderkey, row_number() OVER (PARTITION BY project ORDER BY s, e, o_orderkey) AS place FROM cuts""")
def ordered_intervals(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("project").orderBy("start", "end", "o_orderkey"))
    return cuts(spark, sf_dir).select("project", "o_orderkey", place.cast("long").alias("place"))


@query(f"WITH {STEREO} SELECT pair, sample, round(sqrt(avg(v * v)), 6) AS v FROM stereo GROUP BY ALL")
def channel_rms(spark, sf_dir):
    return rounded(signals.channel_rms(stereo(spark, sf_dir), ["pair"]), "v")


@query(f"WITH {SIGNAL} SELECT vec_id, sample - 10 AS sample, v FROM signal WHERE sample >= 10 AND sample < 25")
def sample_window(spark, sf_dir):
    return signals.window_of(signal(spark, sf_dir), "vec_id", 10, 25, 1000).select("vec_id", "sample", "v")


@query(f"WITH {BASE}, n AS (SELECT vec_id, count(*) AS frames FROM signal GROUP BY vec_id) SELECT vec_id, block, lo AS min, hi AS max, round(rms, 6) AS rms, frames FROM base JOIN n USING (vec_id)")
def probe_with_envelope(spark, sf_dir):
    return rounded(signals.probed(signal(spark, sf_dir), "vec_id", 8), "rms")


@query(f"WITH {TOKENS} SELECT user_id, text, CAST(s // {240 * HOUR} AS BIGINT) AS span, min(event_id) AS event_id FROM tokens GROUP BY ALL")
def distinct_windows(spark, sf_dir):
    rows = tokens(spark, sf_dir).select("user_id", "text", F.floor(F.col("start") / (240 * HOUR)).alias("span"), "event_id")
    return projects.without_repeats(rows, ["user_id", "text", "span"], "event_id")
