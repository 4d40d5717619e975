import io
import wave
import zipfile

import numpy as np
import pytest

from spanloom import sinks, streaming
from spanloom.operators import exports, options, records, signals, tracks
from spanloom.plans import session
from spanloom.sources import wav


def test_wav_source(spark, tmp_path):
    session.ship(spark)
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(np.array([0, 16384, -32768, 8192], "<i2").tobytes())
    wav.register(spark)
    rows = spark.read.format("pcm_wav").load(str(tmp_path)).orderBy("sample", "channel").collect()
    assert [(r.sample, r.channel, r.v) for r in rows] == [(0, 0, 0.0), (0, 1, 0.5), (1, 0, -1.0), (1, 1, 0.25)]


def test_wav_ranges_and_headers(spark, tmp_path, monkeypatch):
    session.ship(spark)
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(1000)
        f.writeframes(np.arange(300, dtype="<i2").tobytes())
    monkeypatch.setattr(wav, "RANGE", 64)
    assert [(p.first, p.last) for p in wav.WavReader(str(tmp_path), 100, 260).partitions()] == [(100, 164), (164, 228), (228, 260)]
    wav.register(spark)
    part = spark.read.format("pcm_wav").option("first", 100).option("last", 260).load(str(tmp_path))
    assert sorted((r.sample, round(r.v * 32768)) for r in part.collect()) == [(k, k) for k in range(100, 260)]
    info = spark.read.format("pcm_wav_info").load(str(tmp_path)).first()
    assert (info.sample_rate, info.channels, info.total_samples, info.duration_ms, info.codec_name) == (1000, 1, 300, 300, "pcm_s16le")
    whole = spark.read.format("pcm_wav").load(str(tmp_path))
    told = signals.probed(whole, "path", 100).orderBy("block").collect()
    assert [(r.block, round(r.max * 32768), r.frames) for r in told] == [(0, 99, 300), (1, 199, 300), (2, 299, 300)]
    cut = signals.window_of(whole, "path", 50, 60, 1000)
    assert sorted((r.sample, round(r.v * 32768)) for r in cut.collect()) == [(k, 50 + k) for k in range(10)]
    (tmp_path / "b.wav").write_bytes(b"no audio")
    with pytest.raises((ValueError, EOFError, wave.Error)):
        wav.WavReader(str(tmp_path)).partitions()

    class LessThan:
        attribute, value = ("sample",), 70

    reader = wav.WavReader(str(tmp_path / "a.wav"))
    assert list(reader.pushFilters([LessThan()])) == [] and [(p.first, p.last) for p in reader.partitions()] == [(0, 64), (64, 70)]
    assert signals.points_block(48_000 * 10, 48_000) == 40 and signals.points_block(48_000 * 600, 48_000) == 240


def document(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{wav.WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_source(spark, tmp_path):
    session.ship(spark)
    run = '<w:r><w:rPr><w:highlight w:val="yellow"/></w:rPr><w:t>cd</w:t><w:tab/></w:r>'
    (tmp_path / "a.docx").write_bytes(document(f"<w:p><w:r><w:t>ab</w:t></w:r>{run}</w:p>"))
    wav.register(spark)
    rows = spark.read.format("docx_runs").load(str(tmp_path)).orderBy("run").collect()
    assert [(r.paragraph, r.text, r.highlight) for r in rows] == [(0, "ab", None), (0, "cd\t", "yellow")]
    hyphens = document("<w:p><w:r><w:t>a</w:t><w:noBreakHyphen/><w:t>b</w:t><w:softHyphen/><w:t>c</w:t></w:r></w:p>")
    assert [x[2] for x in wav.runs_of(io.BytesIO(hyphens))] == ["a\u2011b\u00adc"]
    with pytest.raises(ValueError):
        list(wav.runs_of(io.BytesIO(b"no archive")))


def test_commit_is_all_or_nothing(tmp_path):
    finals = [tmp_path / f"f{k}" for k in range(3)]
    for f in finals:
        f.write_text("old")
    staged = {tmp_path / f"s{k}": f for k, f in enumerate(finals)}
    for s in list(staged)[:2]:
        s.write_text("new")
    with pytest.raises(OSError):
        sinks.commit(staged)
    assert [f.read_text() for f in finals] == ["old"] * 3
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".")]
    for s in staged:
        s.write_text("new")
    sinks.commit(staged)
    assert [f.read_text() for f in finals] == ["new"] * 3
    (tmp_path / "s0").write_text("newer")
    with pytest.raises(FileExistsError):
        sinks.commit({tmp_path / "s0": finals[0]}, overwrite=False)
    assert finals[0].read_text() == "new" and len(sinks.tree_digest(tmp_path)) == 64


def test_json_and_cut_list(spark, tmp_path):
    path = tmp_path / "p.json"
    sinks.save_json({"a": "ä"}, path)
    assert sinks.load_json(path) == {"a": "ä"}
    path.write_bytes(b"\xef\xbb\xbf{}")
    assert sinks.load_json(path) == {}
    df = spark.createDataFrame([(1, 480, 960)], "project long, start long, end long")
    data = sinks.cut_list_csv(sinks.cut_list(df, ["project"], 48000).collect())
    assert data.startswith(b"\xef\xbb\xbfindex,") and b"1,480,960,480,0.010000,0.020000" in data


def test_streaming_envelope_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT id % 3 AS k, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts, CAST(id % 17 AS DOUBLE) AS v FROM range(2000)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.envelope(stream, "k", "ts", "v", "5 minutes").writeStream.format("memory").queryName("env").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = streaming.envelope(rows, "k", "ts", "v", "5 minutes")
    assert sorted(map(tuple, spark.table("env").collect())) == sorted(map(tuple, batch.collect()))


def test_streams_from_files_equal_batches(spark, tmp_path):
    session.ship(spark)
    rows = spark.sql("SELECT id % 3 AS k, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * id % 977) AS ts, CAST(id % 17 AS DOUBLE) AS v FROM range(900)")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.table_stream(spark, str(tmp_path / "in"))
    sessions = streaming.completed(streaming.gap_sessions(stream, "k", "ts", 3_000_000), "sessions")
    assert sorted(map(tuple, sessions.collect())) == sorted(map(tuple, streaming.gap_sessions(rows, "k", "ts", 3_000_000).collect()))
    blocks = streaming.completed(streaming.envelope(stream, "k", "ts", "v", "1 minute"), "blocks")
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, streaming.envelope(rows, "k", "ts", "v", "1 minute").collect()))


def test_self_test_and_programs(spark, tmp_path):
    session.ship(spark)
    told = exports.self_test(spark, tmp_path / "told.json")
    assert told["ok"] and sinks.load_json(tmp_path / "told.json") == told
    (tmp_path / "tool").write_text("")
    assert exports.program("tool", beside=str(tmp_path / "other")) == tmp_path / "tool" == exports.program("x", explicit=str(tmp_path / "tool"))
    assert exports.program("no-such-program") is None
    assert records.platform_key("darwin", "ARM64") == "macos-arm64" and records.platform_key("linux", "x86_64") == "linux-x86_64"
    assert options.option_key({"b": {2, 1}, "a": (1, None)}) == options.option_key({"a": [1, None], "b": [1, 2]})
    loads = []
    assert tracks.kept({"a": 1}, lambda: loads.append(1) or "model") == tracks.kept({"a": 1}, lambda: loads.append(1) or "other") == "model" and loads == [1]


def test_sessions_split_at_exactly_the_gap(spark):
    rows = spark.sql("SELECT 1 AS k, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, s) AS ts FROM VALUES (0), (10), (15) AS t(s)")
    out = streaming.gap_sessions(rows, "k", "ts", 10_000_000).collect()
    assert sorted(r.tokens for r in out) == [1, 2]
