"""Named queries of the engine and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom import sinks, streaming
from spanloom.functions import labels
from spanloom.functions import text as T
from spanloom.operators import align, intervals, markup, projects, refine, review, scoring, segments, signals
from spanloom.plans.carriers import CUTS, EVIDENCE, SCORED, SIGNAL, TOKENS, cuts, evidence, signal, table, tokens

HOUR = 3_600_000_000
#: Bounds of the window that complements are taken in, in days.
LOW, HIGH = 0, 2500
DIGITS = 6

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


ISLANDS = f"""{CUTS}, f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY project ORDER BY s, e, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM cuts),
  g AS (SELECT *, sum(new) OVER (PARTITION BY project ORDER BY s, e, o_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM f),
  merged AS (SELECT project, min(s) AS s, max(e) AS e FROM g GROUP BY project, island)"""
GAPS = f"""{ISLANDS}, c AS (SELECT project, greatest(s, {LOW}) AS s, least(e, {HIGH}) AS e FROM merged WHERE e > {LOW} AND s < {HIGH}),
  gaps AS (SELECT project, coalesce(lag(e) OVER w, {LOW}) AS s, s AS e FROM c WINDOW w AS (PARTITION BY project ORDER BY s)
    UNION ALL SELECT project, max(e), {HIGH} FROM c GROUP BY project),
  kept AS (SELECT project, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM gaps WHERE e > s)"""


@query(f"WITH {ISLANDS} SELECT project, s AS start, e AS \"end\" FROM merged")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(cuts(spark, sf_dir), ["project"])


@query(f"""WITH {CUTS}, f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY project ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 1 ELSE 0 END AS new FROM cuts),
  g AS (SELECT *, sum(new) OVER (PARTITION BY project ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f)
  SELECT project, min(s) AS start, max(e) AS "end" FROM g GROUP BY project, island""")
def interval_merge_epsilon(spark, sf_dir):
    return intervals.merge(cuts(spark, sf_dir), ["project"], slack=5)


@query(f"WITH {GAPS} SELECT project, s AS start, e AS \"end\" FROM kept")
def interval_complement(spark, sf_dir):
    return intervals.complement(interval_merge(spark, sf_dir), ["project"], LOW, HIGH)


@query(f"""WITH RECURSIVE {GAPS}, n AS (SELECT project, e - s AS len, row_number() OVER (PARTITION BY project ORDER BY s) AS k, count(*) OVER (PARTITION BY project) AS pieces, sum(e - s) OVER (PARTITION BY project) AS raw FROM kept),
  r AS (SELECT project, k, len AS cur, pieces, raw FROM n WHERE k = 1 UNION ALL SELECT r.project, n.k, r.cur + n.len - least(8, r.cur, n.len), r.pieces, r.raw FROM r JOIN n ON n.project = r.project AND n.k = r.k + 1)
  SELECT project, pieces, CAST(cur AS BIGINT) AS kept_length, CAST(raw AS BIGINT) AS kept_raw FROM r WHERE k = pieces""")
def edit_list_length(spark, sf_dir):
    return intervals.edited_length(interval_complement(spark, sf_dir), ["project"], 8)


@query(f"""WITH {TOKENS}, f AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= {6 * HOUR} THEN 1 ELSE 0 END AS new FROM tokens)
  SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM f""")
def gap_segments(spark, sf_dir):
    return segments.by_gap(tokens(spark, sf_dir), ["user_id"], ["start", "event_id"], "start", "end", 6 * HOUR).select("user_id", "event_id", "segment")


@query(f"""WITH RECURSIVE {TOKENS}, n AS (SELECT user_id, s, e, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1 AS token FROM tokens),
  r AS (SELECT user_id, token, s, e, s AS origin, 0 AS segment FROM n WHERE token = 0
    UNION ALL SELECT n.user_id, n.token, n.s, n.e, CASE WHEN n.s - r.e >= {6 * HOUR} OR n.s - r.origin >= {8 * HOUR} THEN n.s ELSE r.origin END,
      r.segment + CASE WHEN n.s - r.e >= {6 * HOUR} OR n.s - r.origin >= {8 * HOUR} THEN 1 ELSE 0 END FROM r JOIN n ON n.user_id = r.user_id AND n.token = r.token + 1)
  SELECT user_id, token, s AS start, CAST(segment AS BIGINT) AS segment FROM r""")
def gap_or_length_segments(spark, sf_dir):
    return segments.by_gap_or_length(tokens(spark, sf_dir), ["user_id"], ["start", "event_id"], "start", "end", 6 * HOUR, 8 * HOUR)


@query(f"""WITH {TOKENS}, v AS (SELECT user_id, min(s) AS s, max(e) AS e FROM (SELECT *, s // {24 * HOUR} AS day FROM tokens) GROUP BY user_id, day),
  b AS (SELECT user_id, (e + lead(s) OVER (PARTITION BY user_id ORDER BY s, e)) / 2 AS boundary FROM v),
  n AS (SELECT user_id, (s + e) / 2 AS mid, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1 AS token FROM tokens),
  k AS (SELECT b.user_id, boundary, min(token) AS token FROM b JOIN n ON n.user_id = b.user_id AND n.mid >= boundary GROUP BY ALL)
  SELECT user_id, token, min(boundary) AS boundary FROM k GROUP BY user_id, token""")
def voice_boundary_segments(spark, sf_dir):
    rows = tokens(spark, sf_dir)
    voice = rows.groupBy("user_id", F.floor(F.col("start") / (24 * HOUR)).alias("day")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    numbered = rows.select("user_id", ((F.col("start") + F.col("end")) / 2).alias("mid"), (F.row_number().over(Window.partitionBy("user_id").orderBy("start", "event_id")) - 1).alias("token"))
    return segments.by_voice(numbered, voice, "user_id")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, DIGITS) for n in names})


BASE = f"{SIGNAL}, base AS (SELECT vec_id, sample // 8 AS block, min(v) AS lo, max(v) AS hi, sqrt(avg(v * v)) AS rms FROM signal GROUP BY ALL)"


@query(f"WITH {BASE} SELECT vec_id, block, lo AS min, hi AS max, round(rms, {DIGITS}) AS rms FROM base")
def envelope_base(spark, sf_dir):
    return rounded(signals.envelope(signal(spark, sf_dir), "vec_id", 8), "rms")


@query(f"""WITH {SIGNAL}, l0 AS (SELECT vec_id, sample // 5 AS block, min(v) AS lo, max(v) AS hi, sqrt(avg(v * v)) AS rms FROM signal GROUP BY ALL),
  l1 AS (SELECT vec_id, block // 2 AS block, min(lo) AS lo, max(hi) AS hi, sqrt(avg(rms * rms)) AS rms FROM l0 GROUP BY ALL),
  l2 AS (SELECT vec_id, block // 2 AS block, min(lo) AS lo, max(hi) AS hi, sqrt(avg(rms * rms)) AS rms FROM l1 GROUP BY ALL)
  SELECT vec_id, level, block_size, block, lo AS min, hi AS max, round(rms, {DIGITS}) AS rms FROM (SELECT 0 AS level, 5::BIGINT AS block_size, * FROM l0 UNION ALL SELECT 1, 10, * FROM l1 UNION ALL SELECT 2, 20, * FROM l2)""")
def envelope_pyramid(spark, sf_dir):
    return rounded(signals.pyramid(signal(spark, sf_dir), "vec_id", 5, 12, 4, 64), "rms")


@query(f"WITH {BASE} SELECT vec_id, (block - 1) // 2 AS bucket, min(lo) AS min, max(hi) AS max FROM base WHERE block >= 1 AND block < 7 GROUP BY ALL")
def envelope_viewport(spark, sf_dir):
    return signals.viewport(signals.envelope(signal(spark, sf_dir), "vec_id", 8), "vec_id", 1, 7, 3)


@query("""WITH k AS (SELECT vec_id, embedding AS e, unnest(range(0, 43)) AS k FROM embeddings), p AS (SELECT vec_id, e, k, k * 3 // 2 AS i, (k * 3 % 2) / 2.0::DOUBLE AS part FROM k)
  SELECT vec_id, k AS sample, round(CAST(e[i + 1] AS DOUBLE) + part * (CAST(coalesce(e[i + 2], e[i + 1]) AS DOUBLE) - CAST(e[i + 1] AS DOUBLE)), 6) AS v FROM p WHERE k * 3 <= 126""")
def resample(spark, sf_dir):
    return rounded(signals.resampled(signal(spark, sf_dir), "vec_id", 24_000, 16_000), "v")


STEREO = f"{SIGNAL}, stereo AS (SELECT vec_id // 2 AS pair, CAST(vec_id % 2 AS INT) AS channel, sample, v FROM signal)"


def stereo(spark, sf_dir):
    return signal(spark, sf_dir).select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).cast("int").alias("channel"), "sample", "v")


@query(f"WITH {STEREO} SELECT pair, sample, round(avg(v), {DIGITS}) AS v FROM stereo GROUP BY ALL")
def mono_mix(spark, sf_dir):
    return rounded(signals.mono(stereo(spark, sf_dir), ["pair"]), "v")


@query(f"""WITH {STEREO}, r AS (SELECT pair, channel, sqrt(avg(v * v)) AS rms FROM stereo GROUP BY ALL)
  SELECT pair, channel, round(rms, {DIGITS}) AS rms FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY rms DESC, channel) AS k FROM r) WHERE k = 1""")
def channel_energy(spark, sf_dir):
    return rounded(signals.loudest_channel(stereo(spark, sf_dir), ["pair"]), "rms")


LOUD = """loud AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample, value AS v FROM events)"""
FRAMES = f"""{LOUD}, fr AS (SELECT user_id, f AS frame, sqrt(avg(v * v)) AS rms FROM (SELECT *, unnest(CASE WHEN sample = 0 THEN [0] ELSE [sample - 1, sample] END) AS f FROM loud) GROUP BY ALL HAVING count(*) = 2),
  th AS (SELECT user_id, greatest(quantile_cont(rms, 0.2) * pow(10.0, 0.5), max(rms) * pow(10.0, -1.75), 1e-9) AS threshold FROM fr GROUP BY ALL)"""
EDGES = f"""{FRAMES}, o AS (SELECT user_id, frame, rms >= threshold AS loud_on FROM fr JOIN th USING (user_id)),
  st AS (SELECT *, loud_on AND coalesce(lead(loud_on) OVER (PARTITION BY user_id ORDER BY frame), false) AS stable FROM o),
  tr AS (SELECT *, coalesce(lag(stable) OVER (PARTITION BY user_id ORDER BY frame), false) AS was FROM st),
  edges AS (SELECT user_id, 'start' AS kind, frame AS edge FROM tr WHERE stable AND NOT was UNION ALL SELECT user_id, 'end', frame + 2 FROM tr WHERE was AND NOT stable)"""


def loudness(spark, sf_dir):
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(line) - 1).cast("long").alias("sample"), F.col("value").alias("v"))


@query(f"WITH {FRAMES} SELECT user_id, round(threshold, {DIGITS}) AS threshold FROM th")
def noise_floor(spark, sf_dir):
    return rounded(signals.thresholds(signals.frames(loudness(spark, sf_dir), "user_id", 2, 1), "user_id"), "threshold")


@query(f"WITH {EDGES} SELECT user_id, kind, CAST(edge AS BIGINT) AS edge FROM edges")
def energy_edges(spark, sf_dir):
    return signals.energy_edges(loudness(spark, sf_dir), "user_id", 2, 1)


@query(f"WITH {EDGES} SELECT user_id, CAST(edge AS BIGINT) AS edge FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(edge - 20), edge) AS k FROM edges WHERE kind = 'start') WHERE k = 1")
def nearest_edges(spark, sf_dir):
    return signals.nearest_edge(energy_edges(spark, sf_dir), "user_id", 20, "start")


CROSSINGS = f"{SIGNAL}, x AS (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY sample) AS before FROM signal), cr AS (SELECT vec_id, sample, v FROM x WHERE v = 0 OR (before IS NOT NULL AND (v < 0) <> (before < 0)))"


@query(f"WITH {CROSSINGS} SELECT vec_id, sample FROM cr")
def zero_crossings(spark, sf_dir):
    return signals.zero_crossings(signal(spark, sf_dir), "vec_id").select("vec_id", "sample")


@query(f"""WITH {SIGNAL}, seg AS (SELECT * FROM signal WHERE sample BETWEEN 22 AND 38),
  pw AS (SELECT *, sqrt(avg(v * v) OVER (PARTITION BY vec_id ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS p, lag(v) OVER (PARTITION BY vec_id ORDER BY sample) AS before FROM seg),
  pk AS (SELECT *, max(p) OVER (PARTITION BY vec_id) AS peak FROM pw), c AS (SELECT * FROM pk WHERE v = 0 OR (before IS NOT NULL AND (v < 0) <> (before < 0))),
  s AS (SELECT vec_id, sample, round(0.75::DOUBLE * (p / CASE WHEN peak > 0 THEN peak ELSE 1 END) + 0.25::DOUBLE * (abs(sample - 30) / 8.0::DOUBLE), 9) AS score FROM c),
  b AS (SELECT vec_id, sample FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score, sample) AS k FROM s) WHERE k = 1)
  SELECT e.vec_id, coalesce(b.sample, 30) AS crossing FROM embeddings e LEFT JOIN b ON b.vec_id = e.vec_id""")
def best_zero_crossing(spark, sf_dir):
    return signals.best_crossing(signal(spark, sf_dir), "vec_id", 30, 0, 63, 8, 2)


@query(f"""WITH {CUTS} SELECT l.project, l.o_orderkey AS l_key, r.o_orderkey AS r_key FROM cuts l JOIN cuts r ON l.project = r.project AND l.o_orderkey <> r.o_orderkey AND r.e > l.s AND r.s < l.e""")
def token_selection_overlap(spark, sf_dir):
    rows = cuts(spark, sf_dir)
    left = rows.select("project", F.col("start").alias("l_start"), F.col("end").alias("l_end"), F.col("o_orderkey").alias("l_key"))
    right = rows.select("project", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("o_orderkey").alias("r_key"))
    return intervals.overlaps(left, right, ["project"], 30).where("l_key <> r_key").select("project", "l_key", "r_key")


@query(f"""WITH {CUTS} SELECT l.project, l.o_orderkey AS l_key, min(r.s) AS voice_start, max(r.e) AS voice_end, count(*) AS ranges FROM cuts l JOIN cuts r ON l.project = r.project AND l.o_orderkey <> r.o_orderkey AND r.e >= l.s AND r.s <= l.e GROUP BY ALL""")
def voice_overlap(spark, sf_dir):
    rows = cuts(spark, sf_dir)
    left = rows.select("project", F.col("start").alias("l_start"), F.col("end").alias("l_end"), F.col("o_orderkey").alias("l_key"))
    right = rows.select("project", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("o_orderkey").alias("r_key"))
    met = intervals.overlaps(left, right, ["project"], 30, strict=False).where("l_key <> r_key")
    return met.groupBy("project", "l_key").agg(F.min("r_start").alias("voice_start"), F.max("r_end").alias("voice_end"), F.count(F.lit(1)).alias("ranges"))


@query(f"""WITH {ISLANDS}, m AS (SELECT project, o_orderkey, (s + e) / 2 AS mid FROM cuts), v AS (SELECT project, s, e, row_number() OVER (PARTITION BY project ORDER BY s) AS idx FROM merged)
  SELECT m.project, m.o_orderkey, coalesce(min(v.idx), 0) AS range_index FROM m LEFT JOIN v ON v.project = m.project AND m.mid >= v.s - 5 AND m.mid <= v.e + 5 GROUP BY ALL""")
def segment_lookup(spark, sf_dir):
    points = cuts(spark, sf_dir).select("project", "o_orderkey", ((F.col("start") + F.col("end")) / 2).alias("mid"))
    voice = interval_merge(spark, sf_dir).withColumn("idx", F.row_number().over(Window.partitionBy("project").orderBy("start")).cast("long"))
    left = points.select("project", "o_orderkey", F.col("mid").alias("l_start"), F.col("mid").alias("l_end"))
    right = voice.select("project", "idx", (F.col("start") - 5).alias("r_start"), (F.col("end") + 5).alias("r_end"))
    met = intervals.overlaps(left, right, ["project"], 60, strict=False).groupBy("project", "o_orderkey").agg(F.min("idx").alias("idx"))
    return points.select("project", "o_orderkey").join(met, ["project", "o_orderkey"], "left").select("project", "o_orderkey", F.coalesce("idx", F.lit(0).cast("long")).alias("range_index"))


@query(f"""WITH {TOKENS}, g AS (SELECT user_id, event_id, max(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, min(s) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM tokens WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
  SELECT user_id, event_id, CASE WHEN NOT coalesce(r <= l, false) THEN l END AS left_guard, CASE WHEN NOT coalesce(r <= l, false) THEN r END AS right_guard FROM g""")
def neighbor_guards(spark, sf_dir):
    return intervals.guards(tokens(spark, sf_dir), ["user_id"], ["start", "event_id"], "start", "end").select("user_id", "event_id", "left_guard", "right_guard")


@query(f"""WITH {TOKENS}, d AS (SELECT *, s // {24 * HOUR} AS day FROM tokens), g AS (SELECT *, s - max(e) OVER (PARTITION BY user_id, day ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM d)
  SELECT user_id, day, min(s) AS start, max(e) AS "end", count(*) AS spans, round(avg(confidence), {DIGITS}) AS mean_confidence, min(confidence) AS min_confidence, count(confidence) AS available,
    round(count(*) FILTER (confidence < 0.5) / nullif(count(confidence), 0), {DIGITS}) AS low_share, (['character', 'token', 'segment'])[max(list_position(['character', 'token', 'segment'], precision))] AS precision, coalesce(bool_or(gap > {6 * HOUR}), false) AS rejected
  FROM g GROUP BY user_id, day""")
def range_summary(spark, sf_dir):
    rows = tokens(spark, sf_dir).withColumn("day", F.floor(F.col("start") / (24 * HOUR)))
    line = Window.partitionBy("user_id", "day").orderBy("start", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.create_map(*[F.lit(x) for kv in review.RANKS.items() for x in kv])
    return rows.withColumn("gap", F.col("start") - F.max("end").over(line)).groupBy("user_id", "day").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("spans"), F.round(F.avg("confidence"), DIGITS).alias("mean_confidence"), F.min("confidence").alias("min_confidence"), F.count("confidence").alias("available"),
        F.round(F.count_if(F.col("confidence") < 0.5) / F.nullif(F.count("confidence"), F.lit(0)), DIGITS).alias("low_share"), F.max_by("precision", rank[F.col("precision")]).alias("precision"), F.coalesce(F.bool_or(F.col("gap") > 6 * HOUR), F.lit(False)).alias("rejected"),
    )


NORM = r"regexp_replace(replace(lower(text), 'ß', 'ss'), '[\p{P}\p{S}\p{C}\p{Z}\s]', '', 'g')"


@query(f"SELECT doc_id, sha256({NORM}) AS norm_sha256, length({NORM}) AS norm_chars FROM documents")
def normalized_text(spark, sf_dir):
    norm = T.normalized(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(norm, 256).alias("norm_sha256"), F.length(norm).cast("long").alias("norm_chars"))


@query(f"SELECT conv_id, turn FROM conversations WHERE length({NORM}) > 0")
def alignable_filter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.length(T.normalized(F.col("text"))) > 0).select("conv_id", "turn")


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'th', ''))) // 2 AS BIGINT) AS th, CAST(len(list_filter(range(1, length(text)), lambda i: text[i:i+1] = 'ee')) AS BIGINT) AS ee FROM documents")
def overlapping_occurrences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.occurrences(F.col("text"), "th").alias("th"), T.occurrences(F.col("text"), "ee").alias("ee"))


def gram_texts(spark, sf_dir):
    """item_id and two texts: a passage, and the same without each seventh character."""
    rows = table(spark, sf_dir, "benchmark")
    norm = T.normalized(F.col("text"))
    return rows.select("item_id", norm.alias("reference")).withColumn("observed", F.regexp_replace("reference", "(.{6}).", "$1"))


PAIRS = f"g0 AS (SELECT item_id, {NORM} AS ref FROM benchmark), g1 AS (SELECT item_id, ref, regexp_replace(ref, '(.{{6}}).', '\\1', 'g') AS obs FROM g0)"


@query(f"""WITH {PAIRS}, r AS (SELECT item_id, substring(ref, i, 4) AS gram, min(i - 1) AS ref_pos FROM g1, LATERAL (SELECT unnest(range(1, length(ref) - 2)) AS i) GROUP BY ALL HAVING count(*) = 1),
  o AS (SELECT item_id, substring(obs, i, 4) AS gram, min(i - 1) AS obs_pos FROM g1, LATERAL (SELECT unnest(range(1, length(obs) - 2)) AS i) GROUP BY ALL HAVING count(*) = 1) SELECT item_id, gram, ref_pos, obs_pos FROM r JOIN o USING (item_id, gram)""")
def unique_ngram_anchors(spark, sf_dir):
    rows = gram_texts(spark, sf_dir)
    return T.unique_gram_pairs(rows.select("item_id", F.col("reference").alias("text")), rows.select("item_id", F.col("observed").alias("text")), ["item_id"], 4).select("item_id", "gram", "ref_pos", "obs_pos")


@query()
def anchor_chain(spark, sf_dir):
    return align.anchor_chains(gram_texts(spark, sf_dir), "item_id")


@query()
def char_alignment(spark, sf_dir):
    return align.align_pairs(gram_texts(spark, sf_dir), "item_id")


@query(f"""WITH RECURSIVE {TOKENS}, t AS (SELECT user_id, event_id, s // {240 * HOUR} AS day, CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -0.02 WHEN event_id % 11 = 0 THEN -0.004 ELSE value / 100.0 END AS a,
    CASE WHEN event_id % 17 = 0 THEN value / 100.0 + 0.003 WHEN event_id % 19 = 0 THEN value / 100.0 + 9 WHEN event_id % 11 = 0 THEN 0.002 ELSE value / 100.0 + 0.04 END AS b FROM tokens),
  d AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) - 1 AS token, CAST(a AS DOUBLE) * 1000 AS s, CAST(b AS DOUBLE) * 1000 AS e FROM t),
  k AS (SELECT *, greatest(s, 0.0::DOUBLE) AS cs, least(e, 8000.0::DOUBLE) AS ce, CASE WHEN s IS NULL OR e IS NULL THEN 'timestamp_pair_invalid' WHEN s < -5 OR e - s < 5 THEN 'timestamp_interval_invalid' WHEN e > 8005 THEN 'timestamp_outside_window'
    WHEN least(e, 8000.0::DOUBLE) - greatest(s, 0.0::DOUBLE) < 5 THEN 'timestamp_collapsed_after_clamp' END AS early FROM d),
  r AS (SELECT user_id, day, token, CASE WHEN early IS NULL THEN cs + 500 END AS start_ms, CASE WHEN early IS NULL THEN ce + 500 END AS end_ms, early AS code, CASE WHEN early IS NULL THEN greatest(cs, -1.0::DOUBLE) ELSE -1.0::DOUBLE END AS ms, CASE WHEN early IS NULL THEN greatest(ce, -1.0::DOUBLE) ELSE -1.0::DOUBLE END AS me FROM k WHERE token = 0
    UNION ALL SELECT user_id, day, token, CASE WHEN ok THEN cs + 500 END, CASE WHEN ok THEN ce + 500 END, CASE WHEN early IS NOT NULL THEN early WHEN NOT ok THEN 'timestamp_not_monotonic' END, CASE WHEN ok THEN greatest(ms, cs) ELSE ms END, CASE WHEN ok THEN greatest(me, ce) ELSE me END
    FROM (SELECT k.user_id, k.day, k.token, cs, ce, early, ms, me, early IS NULL AND cs + 5 >= ms AND ce + 5 >= me AS ok FROM r JOIN k ON k.user_id = r.user_id AND k.day = r.day AND k.token = r.token + 1))
  SELECT user_id, day, token, round(start_ms, 6) AS start_ms, round(end_ms, 6) AS end_ms, code FROM r""")
def validated_timestamps(spark, sf_dir):
    k, v = F.col("event_id"), F.col("value") / F.lit(100.0)
    a = F.when(k % 31 == 0, F.lit(None)).when(k % 13 == 0, -0.02).when(k % 11 == 0, -0.004).otherwise(v)
    b = F.when(k % 17 == 0, v + 0.003).when(k % 19 == 0, v + 9).when(k % 11 == 0, 0.002).otherwise(v + 0.04)
    rows = tokens(spark, sf_dir).select("user_id", "event_id", F.floor(F.col("start") / (240 * HOUR)).alias("day"), a.alias("a"), b.alias("b"), F.lit(500.0).alias("from_ms"), F.lit(8500.0).alias("to_ms"))
    return rounded(segments.accepted_timestamps(rows, ["user_id", "day"], ["event_id"], "a", "b", 1000.0, "from_ms", "to_ms"), "start_ms", "end_ms")


@query(f"WITH {TOKENS} SELECT event_id, CAST(i - 1 AS BIGINT) AS pos, text[i] AS letter, s AS start, e AS \"end\" FROM tokens, LATERAL (SELECT unnest(range(1, length(text) + 1)) AS i) WHERE text[i] NOT IN ('_', '-', ' ')")
def token_explode(spark, sf_dir):
    rows = tokens(spark, sf_dir).select("event_id", F.posexplode(F.split("text", "")).alias("pos", "letter"), "start", "end")
    return rows.where(F.length(T.normalized(F.col("letter"))) > 0).select("event_id", F.col("pos").cast("long").alias("pos"), "letter", "start", "end")


@query("SELECT event_id, CAST(least(greatest(round_even(event_id * 25 / 50.0::DOUBLE * 1000 / 1000, 0), 0), 999999999) AS BIGINT) AS start, CAST(greatest(least(round_even((event_id * 25 / 50.0::DOUBLE + 0.25) * 1000 / 1000, 0), 1000000000), least(greatest(round_even(event_id * 25 / 50.0::DOUBLE, 0), 0), 999999999) + 1) AS BIGINT) AS \"end\" FROM events")
def ms_to_sample(spark, sf_dir):
    ms = F.col("event_id") * 25 / F.lit(50.0)
    return table(spark, sf_dir, "events").select("event_id", T.sample_range(ms, ms + 0.25, 1000, 1_000_000_000).alias("r")).select("event_id", "r.start", "r.end")


def judged(spark, sf_dir):
    return scoring.judged(evidence(spark, sf_dir))


@query(f"WITH {EVIDENCE} SELECT l_orderkey, l_linenumber, round(start_ms, 4) AS start_ms, round(end_ms, 4) AS end_ms FROM e3")
def boundary_fusion(spark, sf_dir):
    return scoring.fused(evidence(spark, sf_dir)).select("l_orderkey", "l_linenumber", F.round("start_ms", 4).alias("start_ms"), F.round("end_ms", 4).alias("end_ms"))


@query(f"WITH {EVIDENCE} SELECT l_orderkey, l_linenumber, short, repeated, ambiguous, insufficient, disagreement, anomaly, coarse, confidence_unavailable, low_confidence, guard_missing FROM ev")
def evidence_flags(spark, sf_dir):
    names = ("short", "repeated", "ambiguous", "insufficient", "disagreement", "anomaly", "coarse", "confidence_unavailable", "low_confidence", "guard_missing")
    return scoring.flags(scoring.fused(evidence(spark, sf_dir))).select("l_orderkey", "l_linenumber", *names)


@query(f"""WITH {EVIDENCE} SELECT l_orderkey, l_linenumber, round_even(apart, 3) AS boundary_disagreement_ms, round_even(greatest(end_ms - start_ms, 0), 3) AS candidate_span_ms,
  round_even(CASE WHEN force AND asr THEN least(am, fm) WHEN asr THEN am WHEN force THEN fm ELSE 0 END, 4) AS alignment_ambiguity_margin, split AS dp_forced_partition, CASE WHEN force THEN round_even(fs, 3) END AS force_start, CASE WHEN asr THEN round_even(t, 3) END AS asr_end, CASE WHEN asr THEN round_even(mc, 4) END AS asr_mean FROM ev""")
def candidate_diagnostics(spark, sf_dir):
    d = scoring.recorded(scoring.fused(evidence(spark, sf_dir)))
    names = ("boundary_disagreement_ms", "candidate_span_ms", "alignment_ambiguity_margin", "dp_forced_partition")
    return d.select("l_orderkey", "l_linenumber", *[f"diagnostics.{n}" for n in names], F.col("diagnostics.force_alignment.start_ms").alias("force_start"), F.col("diagnostics.asr_alignment.end_ms").alias("asr_end"), F.col("diagnostics.asr_alignment.mean_model_confidence").alias("asr_mean"))


@query(f"WITH {EVIDENCE}, {SCORED} SELECT l_orderkey, l_linenumber, confidence FROM scored")
def candidate_score(spark, sf_dir):
    return scoring.confidence(scoring.flags(scoring.fused(evidence(spark, sf_dir)))).select("l_orderkey", "l_linenumber", "confidence")


@query(f"WITH {EVIDENCE}, {SCORED} SELECT l_orderkey, l_linenumber, array_to_string(reasons, ',') AS reasons FROM scored")
def candidate_reasons(spark, sf_dir):
    return judged(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {EVIDENCE}, {SCORED} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM scored) GROUP BY ALL")
def reason_histogram(spark, sf_dir):
    return judged(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVIDENCE}, {SCORED} SELECT l_orderkey, l_linenumber, force AND asr AND NOT short AND NOT repeated AND NOT ambiguous AND NOT insufficient AND NOT disagreement AND NOT unstable AND NOT anomaly AND NOT coarse
  AND NOT confidence_unavailable AND NOT low_confidence AND NOT guard_missing AND located AND local AND confidence >= 0.82 AS auto FROM scored""")
def auto_approve(spark, sf_dir):
    return judged(spark, sf_dir).select("l_orderkey", "l_linenumber", "auto")


@query(f"WITH {TOKENS} SELECT user_id, precision, count(*) AS n, count(confidence) AS available FROM tokens GROUP BY ALL")
def precision_histogram(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("user_id", "precision").agg(F.count(F.lit(1)).alias("n"), F.count("confidence").alias("available"))


def candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "skipped").when(F.col("quality") == 1, "auto_approved").otherwise("needs_review")
    rows = rows.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 20).alias("project"), status.alias("status"), F.col("doc_id").alias("start"), (F.col("doc_id") + 5 + F.col("doc_id") % 9).alias("end"))
    return rows.withColumns({"review_required": (F.col("status") == "needs_review") | ((F.col("status") == "skipped") & (F.col("id") % 2 == 0)), "final_start": F.lit(None).cast("long"), "final_end": F.lit(None).cast("long")})


CANDIDATES = """cand AS (SELECT doc_id AS id, doc_id % 20 AS project, CASE WHEN toxic = 1 THEN 'skipped' WHEN quality = 1 THEN 'auto_approved' ELSE 'needs_review' END AS status, doc_id AS s, doc_id + 5 + doc_id % 9 AS e,
  CASE WHEN toxic = 1 THEN doc_id % 2 = 0 WHEN quality = 1 THEN false ELSE true END AS review_required FROM labels)"""
REVIEWED = f"""{CANDIDATES}, acts AS (SELECT user_id AS id, event_id AS seq, (['approve', 'skip', 'reset'])[event_id % 3 + 1] AS action, CASE WHEN event_id % 4 < 2 THEN event_id END AS a, CASE WHEN event_id % 4 IN (0, 2) THEN event_id + 9 END AS b FROM events),
  valid AS (SELECT * FROM acts WHERE action <> 'approve' OR (a IS NULL) = (b IS NULL)), la AS (SELECT id, arg_max(action, seq) AS action FROM valid GROUP BY id),
  lb AS (SELECT id, action AS bound, a, b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM valid WHERE action IN ('approve', 'reset')) WHERE k = 1),
  rev AS (SELECT c.id, project, s, e, review_required, CASE la.action WHEN 'approve' THEN 'approved' WHEN 'skip' THEN 'skipped' WHEN 'reset' THEN CASE WHEN review_required THEN 'needs_review' ELSE 'auto_approved' END ELSE status END AS status,
    CASE WHEN bound = 'approve' THEN a END AS final_start, CASE WHEN bound = 'approve' THEN b END AS final_end FROM cand c LEFT JOIN la ON la.id = c.id LEFT JOIN lb ON lb.id = c.id)"""


@query(f"WITH {REVIEWED} SELECT id, status, final_start, final_end FROM rev")
def review_fold(spark, sf_dir):
    return reviewed(spark, sf_dir).select("id", "status", "final_start", "final_end")


@query(f"WITH {REVIEWED} SELECT id, coalesce(final_start, s) AS start, coalesce(final_end, e) AS \"end\" FROM rev")
def effective_intervals(spark, sf_dir):
    rows = reviewed(spark, sf_dir).withColumnsRenamed({"start": "suggested_start", "end": "suggested_end"})
    return rows.select("id", review.effective("start").alias("start"), review.effective("end").alias("end"))


@query(f"WITH {REVIEWED} SELECT 'all' AS mode, count(*) AS n FROM rev UNION ALL SELECT 'needs', count(*) FILTER (status = 'needs_review') FROM rev UNION ALL SELECT 'selected', count(*) FILTER (status IN ('auto_approved', 'approved')) FROM rev UNION ALL SELECT 'skipped', count(*) FILTER (status = 'skipped') FROM rev")
def review_modes(spark, sf_dir):
    rows = reviewed(spark, sf_dir)
    modes = ("all", "needs", "selected", "skipped")
    told = rows.agg(*[F.count_if(review.in_mode(m)).alias(m) for m in modes])
    return told.unpivot([], list(modes), "mode", "n").select("mode", "n")


def reviewed(spark, sf_dir):
    action = F.element_at(F.array(*[F.lit(x) for x in ("approve", "skip", "reset")]), (F.col("event_id") % 3 + 1).cast("int"))
    k = F.col("event_id")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), k.alias("at"), action.alias("action"), F.when(k % 4 < 2, k).alias("start"), F.when(k % 4 % 2 == 0, k + 9).alias("end"))
    return review.status_after(candidates(spark, sf_dir), events)


@query(f"WITH {REVIEWED} SELECT id FROM rev WHERE status IN ('auto_approved', 'approved')")
def review_filter(spark, sf_dir):
    return reviewed(spark, sf_dir).where(review.in_mode("selected")).select("id")


@query(f"""WITH {REVIEWED}, o AS (SELECT *, min(CASE WHEN status = 'needs_review' THEN id END) OVER (PARTITION BY project ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead, min(CASE WHEN status = 'needs_review' THEN id END) OVER (PARTITION BY project) AS around FROM rev)
  SELECT project, id, coalesce(ahead, around) AS next_open FROM o""")
def next_unresolved(spark, sf_dir):
    return review.next_open(reviewed(spark, sf_dir), ["project"], "id").select("project", "id", "next_open")


@query(f"""WITH {REVIEWED} SELECT project, count(*) AS candidates, count(*) FILTER (status IN ('auto_approved', 'approved')) AS selected, count(*) FILTER (status = 'needs_review') AS open, count(*) FILTER (status = 'skipped') AS skipped,
  CAST(coalesce(sum(e - s) FILTER (status IN ('auto_approved', 'approved')), 0) AS BIGINT) AS removed FROM rev GROUP BY ALL""")
def review_summary(spark, sf_dir):
    return review.summary(reviewed(spark, sf_dir), ["project"])


@query(f"""WITH {CUTS}, f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY project ORDER BY s, e, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM cuts),
  g AS (SELECT *, sum(new) OVER (PARTITION BY project ORDER BY s, e, o_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT project, arg_min(o_orderkey, row(s, e, o_orderkey)) AS id, min(s) AS start, max(e) AS "end" FROM g GROUP BY project, island""")
def annotation_merge(spark, sf_dir):
    return review.annotations(cuts(spark, sf_dir).withColumnRenamed("o_orderkey", "id"), ["project"])


@query(f"""WITH {TOKENS} SELECT user_id, array_to_string(list_sort(list(DISTINCT precision)), ',') AS precisions, count(confidence) AS available, round_even(avg(confidence), 4) AS mean_confidence, round_even(min(confidence), 4) AS min_confidence,
  array_to_string(list_filter(['boundary_precision_unverified', CASE WHEN bool_or(precision <> 'character') THEN 'coarse_timestamp' END, CASE WHEN count(confidence) < count(*) THEN 'model_confidence_unavailable' END, CASE WHEN min(confidence) < 0.4 THEN 'low_model_confidence' END], lambda x: x IS NOT NULL), ',') AS reasons FROM tokens GROUP BY ALL""")
def annotation_metadata(spark, sf_dir):
    rows = review.token_facts(tokens(spark, sf_dir), ["user_id"])
    return rows.select("user_id", F.array_join("precisions", ",").alias("precisions"), "available", "mean_confidence", "min_confidence", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {TOKENS} SELECT event_id, rule FROM (SELECT event_id, unnest(list_filter([CASE WHEN e <= s THEN 'empty' END, CASE WHEN confidence IS NULL THEN 'no_confidence' END, CASE WHEN confidence > 0.95 THEN 'too_sure' END], lambda x: x IS NOT NULL)) AS rule FROM tokens)""")
def validation_report(spark, sf_dir):
    rules = {"empty": F.col("end") <= F.col("start"), "no_confidence": F.col("confidence").isNull(), "too_sure": F.col("confidence") > 0.95}
    return review.violations(tokens(spark, sf_dir), "event_id", rules)


@query("SELECT user_id, day, times FROM (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS times FROM events GROUP BY ALL) WHERE times > 1")
def duplicate_keys(spark, sf_dir):
    return review.repeated_keys(table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day")), ["user_id", "day"])


@query("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS size, sha256(html) AS sha256 FROM pages")
def source_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("size"), review.fingerprint(F.col("html")).alias("sha256"))


@query("""WITH f AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS size, sha256(html) AS sha256 FROM pages) SELECT a.page_id, b.page_id AS stored FROM f a JOIN f b ON a.size = b.size AND a.sha256 = b.sha256 WHERE b.page_id % 2 = 0""")
def reuse_lookup(spark, sf_dir):
    own = source_fingerprint(spark, sf_dir)
    stored = own.select("size", "sha256", F.col("page_id").alias("stored"), F.when(F.col("page_id") % 2 == 0, "v1").otherwise("v0").alias("strategy"))
    return review.reusable(own, stored, "v1").select("page_id", "stored")


LINES = "lines AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '\u53d1\u8a00\u4eba A ' || printf('%d:%02d', turn, conv_id % 60) ELSE text END AS text FROM conversations)"


def lines(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.format_string(f"{T.SPEAKER} A %d:%02d", "turn", F.col("conv_id") % 60)).otherwise(F.col("text")).alias("text"))


@query(f"WITH {LINES} SELECT conv_id, turn, CASE WHEN regexp_full_match(text, '\u53d1\u8a00\u4eba A \\d{{1,3}}:[0-5]\\d') THEN (CAST(regexp_extract(text, '(\\d+):', 1) AS BIGINT) * 60 + CAST(split_part(text, ':', 2) AS BIGINT)) * 1000 END AS anchor_ms FROM lines")
def anchor_parse(spark, sf_dir):
    return lines(spark, sf_dir).select("conv_id", "turn", T.anchor_ms(F.col("text")).alias("anchor_ms"))


@query(f"""WITH {LINES}, a AS (SELECT *, CASE WHEN turn % 2 = 0 THEN (turn * 60 + conv_id % 60) * 1000 END AS ms FROM lines),
  p AS (SELECT *, count(ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS paragraph, last_value(ms IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upon FROM a)
  SELECT conv_id, paragraph, CAST(min(upon) AS BIGINT) AS anchor_ms, string_agg(text, chr(10) ORDER BY turn) AS body FROM p WHERE ms IS NULL AND paragraph >= 0 AND trim(text) <> '' GROUP BY conv_id, paragraph""")
def paragraph_build(spark, sf_dir):
    return markup.anchored(lines(spark, sf_dir), ["conv_id"], "turn")


@query(f"""SELECT conv_id, turn, CAST(coalesce(sum(length({NORM})) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM conversations""")
def paragraph_offsets(spark, sf_dir):
    return markup.base_offsets(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "base")


RUNS = """wr AS (SELECT conv_id, turn, i AS run, words[i] AS text, i % 4 < 2 AS lit FROM (SELECT conv_id, turn, regexp_extract_all(text, '\\S+\\s*') AS words FROM conversations), LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i)),
  pl AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id, turn ORDER BY run) AS e FROM wr),
  lit AS (SELECT *, e - length(text) AS s, CASE WHEN e - length(text) > max(e) OVER (PARTITION BY conv_id, turn ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM pl WHERE lit),
  il AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY run) AS island FROM lit), hl AS (SELECT conv_id, turn, CAST(min(s) AS BIGINT) AS s, CAST(max(e) AS BIGINT) AS e, string_agg(text, '' ORDER BY run) AS text FROM il GROUP BY conv_id, turn, island)"""


@query(f"WITH {RUNS} SELECT conv_id, turn, s AS start, e AS \"end\", text FROM hl")
def highlight_runs(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+\s*"), F.lit(0))).alias("run", "text"))
    runs = words.select("conv_id", "turn", (F.col("run") + 1).alias("run"), "text", F.when((F.col("run") + 1) % 4 < 2, "Yellow").otherwise("red").alias("highlight"))
    return markup.highlights(runs, ["conv_id", "turn"], F.lower("highlight") == "yellow")


@query(f"WITH {RUNS} SELECT h.conv_id, h.turn, h.s AS start, substring(c.text, greatest(h.s - 12, 0) + 1, h.s - greatest(h.s - 12, 0)) AS before, substring(c.text, h.e + 1, 12) AS after FROM hl h JOIN (SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '\\S+\\s*'), '') AS text FROM conversations) c USING (conv_id, turn)")
def context_window(spark, sf_dir):
    body = F.array_join(F.regexp_extract_all("text", F.lit(r"\S+\s*"), F.lit(0)), "")
    paragraphs = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))
    return markup.with_context(highlight_runs(spark, sf_dir), paragraphs, ["conv_id", "turn"]).select("conv_id", "turn", "start", "before", "after")


@query(f"""WITH {TOKENS}, f AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= {6 * HOUR} THEN 1 ELSE 0 END AS new FROM tokens),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM f), h AS (SELECT *, lag(seg) OVER (PARTITION BY user_id ORDER BY s, event_id) AS was FROM g)
  SELECT user_id, string_agg(CASE WHEN was IS NULL THEN '[' || seg || '] ' || text WHEN was <> seg THEN chr(10) || '[' || seg || '] ' || text ELSE text END, '' ORDER BY s, event_id) AS text FROM h GROUP BY user_id""")
def transcript_render(spark, sf_dir):
    rows = segments.by_gap(tokens(spark, sf_dir), ["user_id"], ["start", "event_id"], "start", "end", 6 * HOUR).withColumn("token", F.struct("start", "event_id"))
    return markup.transcript(rows, ["user_id"], F.col("segment").cast("string"))


@query(f"""WITH {ISLANDS} SELECT project, row_number() OVER (PARTITION BY project ORDER BY s, e) AS "index", s AS start_sample, e AS end_sample, e - s AS length_samples, printf('%.6f', s / 48.0) AS start_seconds, printf('%.6f', e / 48.0) AS end_seconds, '' AS text, '' AS status FROM merged""")
def cut_list(spark, sf_dir):
    return sinks.cut_list(interval_merge(spark, sf_dir), ["project"], 48)


def events_stream(spark, sf_dir):
    return streaming.table_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS block_start, min(value) AS min, max(value) AS max, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY ALL")
def stream_envelope(spark, sf_dir):
    """The streaming envelope over the whole table, read as a stream."""
    rows = streaming.envelope(events_stream(spark, sf_dir), "user_id", "ts", "value", "1 day", "3650 days")
    rows = streaming.completed(rows, "stream-envelope")
    return rounded(rows.withColumn("block_start", F.col("block_start").cast("timestamp_ntz")), "rms")


@query(f"""WITH t AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= {6 * HOUR} THEN 1 ELSE 0 END AS new FROM events),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM t) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS tokens FROM g GROUP BY user_id, seg""")
def stream_gap_sessions(spark, sf_dir):
    rows = streaming.completed(streaming.gap_sessions(events_stream(spark, sf_dir), "user_id", "ts", 6 * HOUR, "3650 days"), "stream-sessions")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query(f"""WITH t AS (SELECT doc_id, {NORM} AS norm, {NORM.replace("text", "substring(text, 11, 4)")} AS target, right({NORM.replace("text", "substring(text, 1, 10)")}, 8) AS before, left({NORM.replace("text", "substring(text, 15, 12)")}, 8) AS after FROM documents),
  n AS (SELECT doc_id, target, len(list_filter(range(1, length(norm) + 1), lambda i: length(target) > 0 AND norm[i:i + length(target) - 1] = target)) AS a, len(list_filter(range(1, length(norm) + 1), lambda i: norm[i:i + length(before || target || after) - 1] = before || target || after)) AS b FROM t)
  SELECT doc_id, a > 1 AND b <> 1 AS repeated FROM n""")
def repeated_context(spark, sf_dir):
    part = lambda a, n: T.normalized(F.substring("text", a, n))
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", labels.is_repeated(T.normalized(F.col("text")), part(11, 4), part(1, 10), part(15, 12)).alias("repeated"))


@query("""SELECT conv_id, turn, round(turn * 1000 + 2 * 5000.0::DOUBLE / greatest(length(text), 1), 6) AS start_ms, round(turn * 1000 + 5 * 5000.0::DOUBLE / greatest(length(text), 1), 6) AS end_ms FROM conversations""")
def fallback_range(spark, sf_dir):
    low = F.col("turn") * 1000
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", labels.proportional(F.length("text"), F.lit(2), F.lit(5), low, low + 5000).alias("r"))
    return rows.select("conv_id", "turn", F.round("r.start", 6).alias("start_ms"), F.round("r.end", 6).alias("end_ms"))


@query("""WITH r AS (SELECT l_orderkey * 37 % 100000 + 4000 AS rate FROM lineitem), d AS (SELECT DISTINCT CAST(rate AS BIGINT) AS rate FROM r UNION SELECT 88200 UNION SELECT 96000),
  k AS (SELECT rate, c, row_number() OVER (PARTITION BY rate ORDER BY abs(rate - c), c DESC) AS n FROM d, (SELECT unnest([8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000]) AS c))
  SELECT rate, CAST(CASE WHEN rate > 48000 AND rate % 44100 = 0 THEN 44100 ELSE c END AS BIGINT) AS mp3_rate FROM k WHERE n = 1""")
def mp3_rate(spark, sf_dir):
    rates = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 37 % 100000 + 4000).alias("rate"))
    rates = rates.union(spark.sql("SELECT * FROM VALUES (88200L), (96000L) AS t(rate)")).distinct()
    return rates.select("rate", labels.mp3_rate(F.col("rate")).cast("long").alias("mp3_rate"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20")
def undo_history(spark, sf_dir):
    return projects.history(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 20)


CONTEXTS = f"""ctx AS (SELECT user_id, CAST(s // {24 * HOUR} AS BIGINT) AS day, event_id AS radius, value * 10 AS start_ms, value * 10 + 300 + event_id % 3 * 20 AS end_ms, (event_id % 50 + 50) / 100.0::DOUBLE AS coverage, confidence, precision, (event_id % 10) / 10.0::DOUBLE AS margin, event_id % 29 <> 0 AS valid FROM tokens)"""


def contexts(spark, sf_dir):
    k = F.col("event_id")
    return tokens(spark, sf_dir).select(
        "user_id", F.floor(F.col("start") / (24 * HOUR)).alias("day"), k.alias("radius"), (F.col("value") * 10).alias("start_ms"), (F.col("value") * 10 + 300 + k % 3 * 20).alias("end_ms"), ((k % 50 + 50) / F.lit(100.0)).alias("coverage"), F.col("confidence").alias("mean_confidence"), F.col("confidence").alias("min_confidence"),
        F.col("confidence").alias("low_share"), "precision", ((k % 10) / F.lit(10.0)).alias("margin"), (k % 29 != 0).alias("valid"), F.lit(1.0).alias("confidence_coverage"), F.lit(None).cast("double").alias("voice_start"), F.lit(None).cast("double").alias("voice_end"),
    )


@query(f"""WITH {TOKENS}, {CONTEXTS} SELECT user_id, day, round(avg(start_ms), 6) AS start_ms, round(avg(end_ms), 6) AS end_ms, min(coverage) AS coverage, round(avg(confidence), 6) AS mean_confidence, min(confidence) AS min_confidence, max(confidence) AS low_share,
  (['character', 'token', 'segment'])[max(list_position(['character', 'token', 'segment'], precision))] AS precision, min(margin) AS margin, bool_and(valid) AS valid, round(greatest(max(start_ms) - min(start_ms), max(end_ms) - min(end_ms)), 6) AS spread, count(*) AS contexts FROM ctx GROUP BY ALL""")
def averaged_ranges(spark, sf_dir):
    out = refine.averaged(contexts(spark, sf_dir), ["user_id", "day"]).drop("confidence_coverage", "voice_start", "voice_end")
    return rounded(out, "start_ms", "end_ms", "mean_confidence", "spread")


@query(f"""WITH {TOKENS}, {CONTEXTS}, g AS (SELECT user_id, day, avg(start_ms) AS s, avg(end_ms) AS e, min(coverage) AS c, greatest(max(start_ms) - min(start_ms), max(end_ms) - min(end_ms)) > 80 AS unstable, count(*) AS contexts FROM ctx GROUP BY ALL),
  f AS (SELECT user_id, day, start_ms, end_ms, coverage FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY radius) AS k FROM ctx) WHERE k = 1)
  SELECT user_id, day, round(CASE WHEN unstable THEN start_ms ELSE s END, 6) AS start_ms, round(CASE WHEN unstable THEN end_ms ELSE e END, 6) AS end_ms, CASE WHEN unstable THEN coverage ELSE c END AS coverage, unstable, NOT unstable AND contexts > 1 AS consensus, contexts FROM g JOIN f USING (user_id, day)""")
def context_consensus(spark, sf_dir):
    out = refine.consensus(contexts(spark, sf_dir), ["user_id", "day"], "radius")
    return rounded(out.select("user_id", "day", "start_ms", "end_ms", "coverage", "unstable", "consensus", "contexts"), "start_ms", "end_ms")


@query(f"""WITH {REVIEWED}, o AS (SELECT project, count(*) FILTER (status = 'needs_review') AS open FROM rev GROUP BY ALL), c AS (SELECT page_id % 20 AS project, count(*) FILTER (page_id % 7 = 0) AS changed FROM pages GROUP BY ALL)
  SELECT project, coalesce(open, 0) AS open, coalesce(changed, 0) AS changed, coalesce(open, 0) = 0 AND coalesce(changed, 0) = 0 AS ready FROM o FULL JOIN c USING (project)""")
def export_gate(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    digest = F.sha2("html", 256)
    sources = pages.select((F.col("page_id") % 20).alias("project"), digest.alias("sha256"), F.when(F.col("page_id") % 7 == 0, "old").otherwise(digest).alias("stored_sha256"), F.lit("x").alias("shape"), F.lit("x").alias("stored_shape"))
    return projects.export_gate(reviewed(spark, sf_dir), sources, ["project"])


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey * 10.0::DOUBLE AS s, l_partkey * 10.0::DOUBLE + l_quantity * 100 AS t, l_linenumber % 2 = 0 AS located, l_suppkey * 50.0::DOUBLE AS anchor, CASE WHEN l_linenumber % 3 > 0 THEN l_suppkey * 50.0::DOUBLE + 9000 END AS upper FROM lineitem)
  SELECT l_orderkey, l_linenumber, greatest(CASE WHEN located THEN s - 5000 ELSE anchor - 800 END, 0) AS start, least(CASE WHEN located THEN t + 5000 ELSE coalesce(upper, 20000) + 800 END, 20000) AS "end" FROM e""")
def search_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    s, anchor = F.col("l_partkey") * 10.0, F.col("l_suppkey") * 50.0
    w = refine.search_window(F.col("l_linenumber") % 2 == 0, s, s + F.col("l_quantity") * 100, anchor, F.when(F.col("l_linenumber") % 3 > 0, anchor + 9000), F.lit(20000.0))
    return rows.select("l_orderkey", "l_linenumber", w.alias("w")).select("l_orderkey", "l_linenumber", "w.start", "w.end")


@query("SELECT available, supported, available >= 4 AND supported >= least(6, available) AS ok FROM (SELECT DISTINCT CAST(l_linenumber + 1 AS BIGINT) AS available, CAST(l_quantity AS BIGINT) % 9 AS supported FROM lineitem)")
def context_support(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") + 1).cast("long").alias("available"), (F.col("l_quantity").cast("long") % 9).alias("supported")).distinct()
    return rows.select("available", "supported", refine.is_supported(F.col("available"), F.col("supported")).alias("ok"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 3 AS BIGINT) AS a, CAST(l_linenumber * 3 + 4 AS BIGINT) AS b, l_partkey * 1.0::DOUBLE AS s, l_partkey * 1.0::DOUBLE + 400 AS t FROM lineitem)
  SELECT l_orderkey, l_linenumber, greatest(a, 5) AS start, least(b, 14) AS "end", round(s + 100 * (greatest(a, 5) - a), 6) AS start_ms, round(s + 100 * (least(b, 14) - a), 6) AS end_ms FROM c WHERE least(b, 14) > greatest(a, 5)""")
def clipped_spans(spark, sf_dir):
    a = (F.col("l_linenumber") * 3).cast("long")
    s = F.col("l_partkey").cast("double")
    r = labels.interpolated(a, a + 4, s, s + 400, F.lit(5).cast("long"), F.lit(14).cast("long"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r")).where("r IS NOT NULL")
    return rows.select("l_orderkey", "l_linenumber", "r.start", "r.end", F.round("r.start_ms", 6).alias("start_ms"), F.round("r.end_ms", 6).alias("end_ms"))


@query()
def refine_cuts(spark, sf_dir):
    """A predicted cut for each user over the user's own signal, centred, at 100 samples a second."""
    heard = loudness(spark, sf_dir)
    centred = heard.join(heard.groupBy("user_id").agg(F.avg("v").alias("_m"), F.max("sample").alias("n")), "user_id").withColumn("v", F.col("v") - F.col("_m"))
    cand = centred.groupBy("user_id").agg(F.max("n").alias("n")).select(
        "user_id", F.floor(F.col("n") / 4).alias("predicted_start"), F.floor(F.col("n") * 3 / 4).alias("predicted_end"), F.when(F.col("user_id") % 2 == 0, F.floor(F.col("n") / 8)).alias("left_guard"), F.when(F.col("user_id") % 3 == 0, F.floor(F.col("n") * 7 / 8)).alias("right_guard"),
        F.when(F.col("user_id") % 5 == 0, F.floor(F.col("n") / 4) + 2).alias("vad_start"), F.lit(None).cast("long").alias("vad_end"),
    )
    return refine.refine(cand, centred.select("user_id", "sample", "v"), "user_id", "user_id", 100).select("user_id", "refined_start", "refined_end", "expanded", "review_required", "review_reasons", "start_method", "end_method")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, cuts, removed, kept: what merged cuts take and what they leave of the window."""
    merged = interval_merge(spark, sf_dir)
    removed = intervals.clamp(merged, LOW, HIGH).groupBy("project").agg(F.count(F.lit(1)).alias("cuts"), F.sum(F.col("end") - F.col("start")).alias("removed"))
    kept = intervals.edited_length(intervals.complement(merged, ["project"], LOW, HIGH), ["project"], 8)
    return removed.join(kept.select("project", "kept_length"), "project", "left")
