"""Queries of stored records: typed fields, rules, older forms, edits, and what a project needs to be opened again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as T
from spanloom.operators import exports, projects, records
from spanloom.plans.carriers import CUTS, TOKENS, cuts, table, tokens
from spanloom.plans.catalogue import GAPS, HIGH, LINES, LOW, NORM, lines, query, review


def joined(column: str):
    return F.array_join(column, ",").alias(column)


def told(*names: str) -> str:
    """SQL: the names of the rules that hold, from pairs 'name: test'."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in (n.split(": ", 1) for n in names)) + "], lambda x: x IS NOT NULL), ',')"


RAW = """raw AS (SELECT event_id AS k, '{"id":' || CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN '"7"' WHEN 2 THEN '1.5' ELSE CAST(event_id AS VARCHAR) END || ',"score":' || CASE event_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '0.25' WHEN 2 THEN '"a"' ELSE 'null' END
    || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"name":"n' || event_id || '"' END || CASE event_id % 7 WHEN 0 THEN ',"flag":1' WHEN 1 THEN ',"flag":true' ELSE '' END || CASE event_id % 6 WHEN 0 THEN ',"note":null' WHEN 1 THEN ',"note":5' WHEN 2 THEN ',"note":"x"' ELSE '' END
    || ',"tags":' || CASE event_id % 8 WHEN 0 THEN '["a",1]' WHEN 1 THEN '"a"' ELSE '["a","b"]' END || '}' AS j FROM events)"""


def raw_records(spark, sf_dir):
    k = F.col("event_id")
    pick = lambda n, options, other: F.concat(*[F.when(k % n == i, F.lit(o)).otherwise(F.lit("")) for i, o in options.items()], F.when(~(k % n).isin(*options), other if not isinstance(other, str) else F.lit(other)).otherwise(F.lit("")))
    whole = F.concat(
        F.lit('{"id":'), pick(5, {0: "true", 1: '"7"', 2: "1.5"}, k.cast("string")), F.lit(',"score":'), pick(4, {0: "1", 1: "0.25", 2: '"a"'}, "null"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(',"name":"n'), k.cast("string"), F.lit('"'))),
        pick(7, {0: ',"flag":1', 1: ',"flag":true'}, ""), pick(6, {0: ',"note":null', 1: ',"note":5', 2: ',"note":"x"'}, ""), F.lit(',"tags":'), pick(8, {0: '["a",1]', 1: '"a"'}, '["a","b"]'), F.lit("}"),
    )
    return table(spark, sf_dir, "events").select(k.alias("k"), whole.alias("j"))


@query(f"""WITH {RAW} SELECT k, CASE WHEN k % 5 > 2 THEN k END AS id, CASE k % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.25::DOUBLE END AS score, CASE WHEN k % 3 = 0 THEN 'none' ELSE 'n' || k END AS name, CASE WHEN k % 7 = 0 THEN NULL ELSE k % 7 = 1 END AS flag, CASE WHEN k % 6 = 1 THEN 5::BIGINT END AS note,
  CASE WHEN k % 8 > 1 THEN 'a,b' END AS tags, {told("type:id: k % 5 < 3", "type:score: k % 4 > 1", "type:flag: k % 7 = 0", "type:note: k % 6 = 2", "type:tags: k % 8 < 2")} AS problems FROM raw""")
def record_fields(spark, sf_dir):
    spec = {"id": ("int", records.REQUIRED), "score": ("number", records.REQUIRED), "name": ("string", "none"), "flag": ("bool", False), "note": ("int", records.NULLABLE), "tags": ("strings", [])}
    return records.fields(raw_records(spark, sf_dir), "j", spec).select("k", "id", "score", "name", "flag", "note", joined("tags"), joined("problems"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_id END AS start, CASE WHEN event_id % 4 < 2 THEN event_id + 5 END AS "end" FROM events""")
def interval_records(spark, sf_dir):
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, F.format_string('{"start_sample": %d, "end_sample": %d}', k, k + 5)).when(k % 4 == 1, F.format_string("[%d, %d]", k, k + 5)).when(k % 4 == 2, F.lit("[1, 2, 3]")).otherwise(F.lit('"x"'))
    return table(spark, sf_dir, "events").select("event_id", records.interval_of(raw).alias("r")).select("event_id", "r.start", "r.end")


LINE_K = "l_orderkey * 7 + l_linenumber"


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, {LINE_K} AS k FROM lineitem),
  f AS (SELECT *, CASE WHEN k % 31 = 0 THEN ' ' WHEN k % 37 = 0 THEN 'same' ELSE 'c' || k END AS id, CASE WHEN k % 29 = 0 THEN -1 ELSE l_orderkey END AS p, CASE WHEN k % 41 = 0 THEN 0 ELSE l_linenumber END AS h, k % 3 = 0 AS review, CASE WHEN k % 19 = 0 THEN 'odd' WHEN k % 2 = 0 THEN 'auto_approved' ELSE 'skipped' END AS status,
    CASE WHEN k % 23 = 0 THEN 1.5 WHEN k % 43 = 0 THEN NULL ELSE 0.5 END AS conf, k % 100 AS s, k % 100 + k % 11 AS e, CASE WHEN k % 5 = 0 THEN k % 50 END AS fs, CASE WHEN k % 5 = 0 AND k % 13 <> 0 THEN k % 50 + k % 7 END AS fe FROM c),
  n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, id) AS same_id, count(*) OVER (PARTITION BY l_orderkey, p, h) AS same_place FROM f)
  SELECT l_orderkey, l_linenumber, {told("id_empty: trim(id) = ''", "place_negative: p < 0", "text_empty: k % 47 = 0", "suggested_interval: NOT e > s", "confidence_range: conf IS NULL OR conf > 1", "status_unknown: status = 'odd'", "review_skipped: review AND status = 'auto_approved'", "final_half: (fs IS NULL) <> (fe IS NULL)", "final_interval: fs IS NOT NULL AND fe IS NOT NULL AND NOT fe > fs", "beyond_audio: coalesce(fe, e) > 100", "id_repeated: same_id > 1", "place_repeated: same_place > 1")} AS problems FROM n""")
def record_violations(spark, sf_dir):
    k = F.col("k")
    none = F.lit(None).cast("long")
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") * 7 + F.col("l_linenumber")).select(
        "l_orderkey", "l_linenumber", F.when(k % 31 == 0, " ").when(k % 37 == 0, "same").otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("id"), F.when(k % 29 == 0, -1).otherwise(F.col("l_orderkey")).alias("paragraph_index"), F.when(k % 41 == 0, 0).otherwise(F.col("l_linenumber")).alias("highlight_index"),
        F.when(k % 47 == 0, "").otherwise("text").alias("text"), (k % 100).alias("suggested_start"), (k % 100 + k % 11).alias("suggested_end"), F.when(k % 23 == 0, 1.5).when(k % 43 == 0, F.lit(None)).otherwise(0.5).alias("confidence"),
        F.when(k % 19 == 0, "odd").when(k % 2 == 0, "auto_approved").otherwise("skipped").alias("status"), (k % 3 == 0).alias("review_required"), none.alias("source_start"), none.alias("source_end"),
        F.when(k % 5 == 0, k % 50).alias("final_start"), F.when((k % 5 == 0) & (k % 13 != 0), k % 50 + k % 7).alias("final_end"), F.lit(100).cast("long").alias("total_samples"),
    )
    return records.candidate_problems(rows, ["l_orderkey"]).select("l_orderkey", "l_linenumber", joined("problems"))


@query(f"""WITH {TOKENS}, t AS (SELECT user_id, event_id, event_id % 53 AS a, event_id % 53 + event_id % 9 AS b, CASE WHEN event_id % 61 = 0 THEN 1.2 ELSE confidence END AS c, CASE WHEN event_id % 59 = 0 THEN 'word' ELSE precision END AS precision, lag(event_id % 53) OVER w AS la, lag(event_id % 53 + event_id % 9) OVER w AS lb FROM tokens WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT event_id, {told("interval: NOT (a < b AND b <= 60)", "confidence_range: c IS NULL OR c > 1", "precision_unknown: precision = 'word'", "order: coalesce(a < la OR b < lb, false)")} AS problems FROM t""")
def token_violations(spark, sf_dir):
    k = F.col("event_id")
    rows = tokens(spark, sf_dir).select("user_id", k, "text", (k % 53).alias("start"), (k % 53 + k % 9).alias("end"), F.when(k % 61 == 0, 1.2).otherwise(F.col("confidence")).alias("confidence"), F.when(k % 59 == 0, "word").otherwise(F.col("precision")).alias("precision"), F.lit(60).alias("total_samples"))
    return records.token_problems(rows, ["user_id"], "event_id").select("event_id", joined("problems"))


@query(f"""WITH {CUTS}, n AS (SELECT *, count(*) OVER (PARTITION BY project, o_orderkey // 3) AS same FROM cuts)
  SELECT o_orderkey, {told("operation: o_orderkey % 11 = 0", "text_empty: o_orderkey % 13 = 0", "token_range: NOT (o_orderkey % 9 < o_orderkey % 10 AND o_orderkey % 10 <= 8)", "interval: NOT (s >= 0 AND e <= 2400)", "reason_blank: o_orderkey % 7 = 0", "reasons_missing: o_orderkey % 7 = 1", "id_repeated: same > 1")} AS problems FROM n""")
def annotation_violations(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = cuts(spark, sf_dir).select(
        "project", k, F.floor(k / 3).cast("string").alias("id"), F.when(k % 11 == 0, "keep").otherwise("delete").alias("operation"), F.when(k % 13 == 0, "").otherwise("text").alias("text"), (k % 9).alias("token_start"), (k % 10).alias("token_end"), F.lit(8).alias("tokens"),
        "start", "end", F.lit(2400).alias("total_samples"), F.lit(True).alias("review_required"), F.when(k % 7 == 0, F.array(F.lit(""))).when(k % 7 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("review_reasons"),
    )
    return records.annotation_problems(rows, ["project"]).select("o_orderkey", joined("problems"))


@query("""WITH s AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN turn + 1 WHEN conv_id % 7 = 0 AND turn > 1 THEN 1 ELSE turn END AS start, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
  b AS (SELECT *, row_number() OVER w AS k, lag(start) OVER w AS before FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT DISTINCT conv_id FROM b WHERE (k = 1 AND start <> 0) OR start <= before OR start >= n""")
def segment_start_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("tokens", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    start = F.when(F.col("conv_id") % 5 == 0, F.col("turn") + 1).when((F.col("conv_id") % 7 == 0) & (F.col("turn") > 1), 1).otherwise(F.col("turn"))
    return records.segment_problems(rows.withColumn("start", start), ["conv_id"], "turn")


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 700 * 1000 // 44100 WHEN p_partkey % 3 = 1 THEN p_partkey * 700 * 1000 // 44100 + p_partkey % 2 ELSE p_partkey * 700 * 1000 // 44100 END AS duration_ms,
  {told("channels: p_partkey % 17 = 0", "duration: p_partkey % 3 = 1 AND p_partkey % 2 = 1")} AS problems FROM part""")
def audio_durations(spark, sf_dir):
    k = F.col("p_partkey").cast("long")
    real = F.floor(k * 700 * 1000 / 44100).cast("long")
    stored = F.when(k % 3 == 1, real + k % 2).when(k % 3 == 2, real)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit(44100).alias("sample_rate"), F.when(k % 17 == 0, 0).otherwise(2).alias("channels"), (k * 700).alias("total_samples"), stored.alias("duration_ms"))
    return records.duration_problems(rows).select("p_partkey", "duration_ms", joined("problems"))


@query(f"""WITH {CUTS} SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN true ELSE o_orderkey % 2 = 0 END AS review_required, CASE WHEN o_orderkey % 3 = 0 THEN 'legacy_boundary_precision_unknown' WHEN o_orderkey % 5 = 0 THEN '' ELSE 'a' END AS review_reasons FROM cuts""")
def legacy_records(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = cuts(spark, sf_dir).select(k, F.when(k % 3 != 0, k % 2 == 0).alias("review_required"), F.when(k % 5 != 0, F.array(F.lit("a"))).alias("review_reasons"))
    return projects.with_defaults(rows).select("o_orderkey", "review_required", joined("review_reasons"))


@query(f"""SELECT conv_id, turn, printf('p%04d-h%03d', conv_id, turn) AS id, CASE WHEN length({NORM}) <= 2 OR turn % 4 = 3 THEN 'needs_review' WHEN turn % 4 = 0 THEN 'auto_approved' WHEN turn % 4 = 1 THEN 'approved' ELSE 'skipped' END AS status, length({NORM}) <= 2 OR turn % 4 = 3 AS review_required, CASE WHEN length({NORM}) <= 2 THEN 'a,short_highlight' ELSE 'a' END AS reasons
  FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN left(text, 2) ELSE text END AS text FROM conversations)""")
def stored_candidates(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("auto_approved", "approved", "skipped", "odd"))), (F.col("turn") % 4 + 1).cast("int"))
    text = F.when(F.col("turn") % 3 == 0, F.left("text", F.lit(2))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("conv_id").alias("paragraph"), F.col("turn").alias("highlight"), text.alias("text"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.array(F.lit("a")).alias("reasons"), status.alias("status"), F.lit(False).alias("review_required"))
    out = records.short_downgraded(records.from_alignment(rows), T.normalized(F.col("text")))
    return out.select("conv_id", "turn", "id", "status", "review_required", joined("reasons"))


@query("""SELECT s.s_suppkey, coalesce(n.n_name, 'bundled-local') AS version, coalesce(CAST(n.n_regionkey AS VARCHAR), '') AS digest FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey AND n.n_nationkey % 3 > 0""")
def manifest_models(spark, sf_dir):
    used = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("asr").alias("purpose"), F.col("s_nationkey").cast("string").alias("name"))
    manifest = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("revision"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_regionkey").cast("string")).alias("sha256"))
    return records.with_models(used, manifest).select("s_suppkey", "version", "digest")


@query("""WITH f AS (SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS size, sha256(html) AS sha256 FROM pages), p AS (SELECT page_id, page_id // 2 AS project, size, CASE WHEN page_id % 9 = 0 THEN 'gone' ELSE sha256 END AS sha256, page_id // 2 % 4 > 0 AS current FROM f),
  a AS (SELECT size, sha256, min(url) AS path FROM f GROUP BY ALL), j AS (SELECT p.*, a.path FROM p LEFT JOIN a USING (size, sha256))
  SELECT page_id, path, path IS NOT NULL AS found, current, bool_and(path IS NOT NULL AND current) OVER (PARTITION BY project) AS ready FROM j""")
def reopened_projects(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    files = rows.select("page_id", F.col("url").alias("path"), F.octet_length("html").cast("long").alias("size"), review.fingerprint(F.col("html")).alias("sha256"))
    model = F.struct(*[F.lit(v).alias(k) if k != "version" else F.when(F.floor(F.col("page_id") / 2) % 4 > 0, v).otherwise("5").alias(k) for k, v in records.STRATEGY.items()])
    stored = files.select("page_id", F.floor(F.col("page_id") / 2).alias("project"), "size", F.when(F.col("page_id") % 9 == 0, "gone").otherwise(F.col("sha256")).alias("sha256"), F.array(model).alias("models"))
    return records.reopened(stored, files, "project").select("page_id", "path", "found", "current", "ready")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^(.*)/[^/]*$', 1) ELSE 'out' END AS output_directory FROM pages")
def output_directories(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.when(F.col("page_id") % 2 == 0, "").otherwise("out").alias("output_directory"))
    return records.with_output(rows).select("page_id", "output_directory")


@query("""WITH a AS (SELECT conv_id, turn, (turn * 60 + conv_id % 60 * CASE WHEN turn % 3 = 0 THEN 10 ELSE 1 END) * 1000 AS ms FROM conversations), b AS (SELECT *, lag(ms) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM a)
  SELECT conv_id, turn, CAST(ms AS BIGINT) AS anchor_ms FROM b WHERE ms <= before""")
def unordered_anchors(spark, sf_dir):
    ms = (F.col("turn") * 60 + F.col("conv_id") % 60 * F.when(F.col("turn") % 3 == 0, 10).otherwise(1)) * 1000
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ms.cast("long").alias("anchor_ms"))
    return records.unordered_anchors(rows, ["conv_id"], "turn")


@query(f"""WITH {CUTS}, ed AS (SELECT project, min(o_orderkey) AS id, min(s) AS s, min(s) + 40 AS e, CASE WHEN project % 2 = 0 THEN min(s) - 3 END AS ws, CASE WHEN project % 2 = 0 THEN min(s) + 60 END AS we FROM cuts GROUP BY project),
  m AS (SELECT ed.project, ed.id AS edit, c.o_orderkey, c.s, c.e FROM ed JOIN cuts c ON c.project = ed.project AND c.s <= ed.e AND c.e >= ed.s), t AS (SELECT project, edit, arg_min(o_orderkey, row(s, e, o_orderkey)) AS first, min(s) AS s, max(e) AS e FROM m GROUP BY ALL)
  SELECT ed.project, coalesce(t.first, ed.id) AS id, least(coalesce(ws, ed.s), t.s) AS start, greatest(coalesce(we, ed.e), t.e) AS "end" FROM ed LEFT JOIN t ON t.project = ed.project AND t.edit = ed.id
  UNION ALL SELECT project, o_orderkey, s, e FROM cuts WHERE o_orderkey NOT IN (SELECT o_orderkey FROM m)""")
def annotation_edits(spark, sf_dir):
    rows = cuts(spark, sf_dir).withColumnRenamed("o_orderkey", "id")
    edits = rows.groupBy("project").agg(F.min("id").alias("id"), F.min("start").alias("start"), (F.min("start") + 40).alias("end"))
    drawn = F.col("project") % 2 == 0
    edits = edits.withColumn("wave_start", F.when(drawn, F.col("start") - 3)).withColumn("wave_end", F.when(drawn, F.col("start") + 60))
    return projects.widened(rows.select("project", "id", "start", "end"), edits, ["project"])


@query("SELECT doc_id, quality <> 1 AS review_required, CASE WHEN quality = 1 THEN '' ELSE 'a,b' END AS review_reasons FROM labels")
def confirmed_boundaries(spark, sf_dir):
    told = table(spark, sf_dir, "labels")
    rows = told.select("doc_id", F.lit(True).alias("review_required"), F.array(F.lit("a"), F.lit("b")).alias("review_reasons"))
    return projects.confirmed(rows, told.where("quality = 1"), ["doc_id"]).select("doc_id", "review_required", joined("review_reasons"))


@query(f"WITH {CUTS} SELECT o_orderkey FROM cuts WHERE o_orderkey NOT IN (SELECT l_orderkey + l_linenumber - 1 FROM lineitem)")
def removed_annotations(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") - 1).alias("o_orderkey"))
    return projects.without(cuts(spark, sf_dir), gone, ["o_orderkey"]).select("o_orderkey")


@query(f"""WITH {CUTS}, p AS (SELECT project, min(s) AS s, min(e) AS e FROM cuts GROUP BY project) SELECT project, s AS start, e AS "end" FROM cuts UNION ALL SELECT * FROM p WHERE (project, s, e) NOT IN (SELECT (project, s, e) FROM cuts)""")
def preview_union(spark, sf_dir):
    rows = cuts(spark, sf_dir).select("project", "start", "end")
    return projects.with_preview(rows, rows.groupBy("project").agg(F.min("start").alias("start"), F.min("end").alias("end")), ["project"])


@query("SELECT s_suppkey, array_to_string(list_filter(['ffmpeg', 'ffprobe', 'fa-zh', 'paraformer-zh', 'fsmn-vad'], lambda x: length(x) % 5 <> s_suppkey % 5), ',') AS missing FROM supplier")
def missing_resources(spark, sf_dir):
    wanted = F.array(*map(F.lit, ("ffmpeg", "ffprobe", "fa-zh", "paraformer-zh", "fsmn-vad")))
    there = F.filter(wanted, lambda x: F.length(x) % 5 == F.col("s_suppkey") % 5)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(records.missing(wanted, there), ",").alias("missing"))


@query("""WITH b AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_partkey % 4 AS k FROM part) SELECT path, CASE k WHEN 0 THEN 'removed' WHEN 2 THEN 'changed' END AS change FROM b WHERE k IN (0, 2) UNION ALL SELECT 'new' || path, 'added' FROM b WHERE k = 0""")
def changed_files(spark, sf_dir):
    k = F.col("p_partkey") % 4
    path = F.col("p_partkey").cast("string")
    before, after = (table(spark, sf_dir, "part").select(p.alias("path"), F.lit(1).alias("size"), F.lit(2).alias("modified"), d.alias("sha256")) for p, d in ((path, F.lit("x")), (F.when(k == 0, F.concat(F.lit("new"), path)).otherwise(path), F.when(k == 2, "y").otherwise("x"))))
    return projects.changed_files(before, after)


@query(f"""WITH {LINES}, a AS (SELECT conv_id, max(turn) * 1000 AS last FROM lines GROUP BY conv_id) SELECT conv_id, CAST(last AS BIGINT) AS last_anchor_ms, CAST(conv_id % 5 * 1000 AS BIGINT) AS duration_ms FROM a WHERE last > conv_id % 5 * 1000""")
def anchors_beyond_audio(spark, sf_dir):
    rows = lines(spark, sf_dir).select("conv_id", (F.col("turn") * 1000).cast("long").alias("anchor_ms"))
    durations = rows.select("conv_id").distinct().withColumn("duration_ms", (F.col("conv_id") % 5 * 1000).cast("long"))
    return projects.beyond_duration(rows, durations, "conv_id")


@query(f"""WITH RECURSIVE {GAPS}, n AS (SELECT project, e - s AS len, row_number() OVER (PARTITION BY project ORDER BY s) AS k, count(*) OVER (PARTITION BY project) AS pieces, sum(e - s) OVER (PARTITION BY project) AS raw FROM kept),
  r AS (SELECT project, k, len AS cur, pieces, raw FROM n WHERE k = 1 UNION ALL SELECT r.project, n.k, r.cur + n.len - least(8, r.cur, n.len), r.pieces, r.raw FROM r JOIN n ON n.project = r.project AND n.k = r.k + 1),
  g2 AS (SELECT project, CAST(sum(e - s) AS BIGINT) AS removed FROM c GROUP BY project)
  SELECT g2.project, coalesce(pieces, 0) AS pieces, CAST(coalesce(cur, 0) AS BIGINT) AS kept_length, CAST(coalesce(raw, 0) AS BIGINT) AS kept_raw, removed FROM g2 LEFT JOIN r ON r.project = g2.project AND k = pieces""")
def export_plan(spark, sf_dir):
    return exports.export_plan(cuts(spark, sf_dir), ["project"], LOW, HIGH, 8)


@query(f"""WITH {CUTS}, sel AS (SELECT project, greatest(min(s), 0) AS s, greatest(min(s), 0) + 20 AS e FROM cuts GROUP BY project), w AS (SELECT *, greatest(s - 50, 0) AS low, least(e + 50, 2500) AS high FROM sel),
  u AS (SELECT c.project, greatest(c.s, low) AS s, least(c.e, high) AS e FROM (SELECT project, s, e FROM cuts UNION ALL SELECT project, s, e FROM sel) c JOIN w ON w.project = c.project WHERE least(c.e, high) > greatest(c.s, low)),
  f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY project ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM u), i AS (SELECT *, sum(new) OVER (PARTITION BY project ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f),
  m AS (SELECT project, min(s) AS s, max(e) AS e FROM i GROUP BY project, island),
  gp AS (SELECT m.project, coalesce(lag(m.e) OVER (PARTITION BY m.project ORDER BY m.s), low) AS s, m.s AS e FROM m JOIN w ON w.project = m.project UNION ALL SELECT m.project, max(m.e), max(high) FROM m JOIN w ON w.project = m.project GROUP BY m.project)
  SELECT project, 'original' AS mode, low AS start, high AS "end" FROM w UNION ALL SELECT project, 'selection', s, e FROM sel UNION ALL SELECT project, 'edited', s, e FROM gp WHERE e > s""")
def preview_ranges(spark, sf_dir):
    rows = cuts(spark, sf_dir).select("project", "start", "end")
    first = rows.groupBy("project").agg(F.greatest(F.min("start"), F.lit(0)).cast("long").alias("start")).withColumn("end", F.col("start") + 20)
    return exports.preview_ranges(first, rows, ["project"], 50, 2500)


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'rate' WHEN 2 THEN 'length' END AS problem FROM part""")
def rendered_files(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", (k * 10).alias("expected"), F.when(k % 5 == 2, k * 10 + 2).when(k % 5 != 0, k * 10 + k % 2).alias("found"), F.when(k % 5 == 1, 44100).otherwise(48000).alias("rate"))
    return rows.select("p_partkey", exports.rendered_problems(F.col("expected"), F.col("found"), F.lit(48000), F.col("rate")).alias("problem"))
