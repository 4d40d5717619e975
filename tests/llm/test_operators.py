"""Whole operators on small tables: brute force, nulls, empty tables, repeated rows, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import bpe, chat, components, dedup, langid, matroska, packing, secrets, syncmers, warc, wrappers
from spanloom.llm.common import lookup
from spanloom.plans.session import ship

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig string, length int, edge int, url string"


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(k, prose(rng, rng.choice([1, 3, 4, 30, 90])), "xx") for k in range(60)]
    base = prose(rng, 120).split()
    for k in range(60, 90):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 6, 12])):
            words[rng.randrange(len(words))] = prose(rng, 1)
        out.append((k, " ".join(words), "xx"))
    out += [(k, prose(rng, 40, "uvwxyz"), "yy") for k in range(90, 120)]
    out += [(120, None, None), (121, "", "xx"), (122, " \n", "yy"), (123, "12 34", "yy"), (124, out[5][1].upper(), "xx"), (125, out[5][1], "xx"), (126, "long " * 30000, "xx"), (127, "É漢😀 token = 'abcdef123456'", None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 1, 2, "u") for i, t, lang in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < 4 else zip(words, words[1:], words[2:], words[3:], strict=False))


def brute_components(texts):
    found = {i: i for i in texts}
    shingles = {i: sets(t) for i, t in texts.items()}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(texts, 2) if shingles[a] and shingles[b] and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(found[a], found[b])
            if found[a] != low or found[b] != low:
                found[a] = found[b] = low
                changed = True
    return found, shingles


def test_near_duplicates_equal_brute_force(spark, docs, rows):
    want, shingles = brute_components({i: t for i, t, _ in rows})
    for i, r in by_id(dedup.near_duplicates(docs)).items():
        assert (r.component_id, r.n_shingles, r.kept) == (want[i], len(shingles[i]), want[i] == i)


def test_near_duplicates_in_dense_regions(spark, monkeypatch):
    rng = random.Random(12)
    base = prose(rng, 100).split()
    texts = {}
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = prose(rng, 1) + str(k % 3)
        texts[k] = " ".join(words)
    want, _ = brute_components(texts)
    got = by_id(dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == want


def family_texts(seed, n, words=60, edits=9, fresh=200):
    """Copies of three bases that share a passage, with few to many words changed, some in the same places."""
    rng = random.Random(seed)
    shared = prose(rng, 15).split()
    bases = [shared + [f"{w}{b}" for w in prose(rng, words - 15).split()] for b in range(3)]
    texts = {}
    for k in range(n):
        copy = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 3, rng.randint(0, edits)])):
            copy[rng.choice([rng.randrange(len(copy)), 3, 20, 41])] = f"x{rng.randrange(fresh)}"
        texts[k * 3 - 50] = " ".join(copy[: rng.randint(words - 8, words)])
    return texts


@pytest.mark.parametrize(("seed", "fresh"), [(1, 3), (2, 40), (3, 100_000)])
def test_families_alone_find_every_component(spark, monkeypatch, seed, fresh):
    monkeypatch.setattr(dedup, "PROPOSED", 0)
    texts = family_texts(seed, 150, fresh=fresh)
    want, _ = brute_components(texts)
    got = by_id(dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == want


def test_regions_are_sorted_deeper_the_more_they_hold(spark, monkeypatch):
    monkeypatch.setattr(dedup, "families", lambda members, *_: members.selectExpr("id AS a", "id AS b"))
    texts = family_texts(4, 200, fresh=40)
    want, _ = brute_components(texts)
    got = by_id(dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    links = sum(got[i].component_id == c for i, c in want.items())
    assert links > 150 and all(r.component_id >= want[i] for i, r in got.items())


def test_rows_that_repeat_an_id_with_other_texts(spark):
    rows = [(5, "a b c d e f g"), (5, "t u v w x y z"), (7, "t u v w x y z"), (8, "a b c d e f g"), (9, "q r s t")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 4, 5), (5, 4, 5), (7, 4, 5), (8, 4, 5), (9, 1, 9)]


def test_near_duplicates_of_odd_rows(spark, empty):
    assert dedup.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in dedup.near_duplicates(odd).collect())
    assert got == [(-1, None, True), (3, 3, True), (3, 3, True), (4, 4, True)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}


def test_lookup_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr("spanloom.llm.common.HOT_KEYS", 2)
    left = spark.createDataFrame([("a" if k % 2 else f"k{k % 7}", k) for k in range(100)] + [(None, 100), ("zz", 101)], "key string, v long")
    groups = left.where("key <> 'zz'").groupBy("key").count().selectExpr("key", "upper(key) AS up", "count AS n")
    got = lookup(left, groups, "key", ["up"], "n", F.concat(F.lit("#"), F.col("v").cast("string"))).collect()
    assert len(got) == 102 and all((r.up == r.key.upper()) if r.key not in (None, "zz") else r.up is None for r in got)


def test_bpe_rows(docs, rows, empty):
    t = Tokenizer.from_file(BYTE)
    got = by_id(bpe.round_trip(docs, BYTE))
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(empty, BYTE).count() == 0
    assert {r.doc_id: len(r.ids) for r in bpe.encode_column(docs, BYTE).collect()} == {i: r.n_tokens for i, r in got.items()}


def test_packing_rows(spark, docs, rows, empty):
    t = Tokenizer.from_file(WORD)
    for table, times in ((docs, 1), (docs.unionByName(docs), 2)):
        placed = packing.pack(table, WORD).collect()
        want = []
        for i, text, _ in rows:
            ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
            want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == sorted(want * times)
        used = {}
        for r in placed:
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(used) == packing.lower_bound({n: sum(r.length == n for r in placed) for n in {r.length for r in placed}}, 4096)
    assert packing.pack(empty, WORD).count() == 0


def test_media_rows(docs, rows, empty):
    got = by_id(matroska.round_trip(docs))
    for i, text, _ in rows:
        payload, n = matroska.padded(text or "")
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
    assert got[120].feature == got[121].feature and matroska.round_trip(empty).count() == 0
    table = matroska.packets(matroska.media_column(docs))
    assert table.where("length <> 576").count() == 0 and table.count() == sum(r.payload_bytes for r in got.values()) // 576


def plain_elements(data):
    """(id, content) of a run of EBML elements: a second reader, for ids and sizes alone."""
    at = 0
    while at < len(data):
        width = next(w for w in range(1, 9) if data[at] >> (8 - w))
        kind, at = data[at : at + width].hex(), at + width
        width = next(w for w in range(1, 9) if data[at] >> (8 - w))
        size = int.from_bytes(data[at : at + width], "big") - (1 << 7 * width)
        at += width
        yield kind, data[at : at + size]
        at += size
    assert at == len(data)


def test_media_equal_a_second_reader(docs, rows):
    stored = {r.doc_id: r for r in matroska.media_column(docs).collect()}
    got = by_id(matroska.round_trip(docs))
    for i, text, _ in rows:
        data, raw = bytes(stored[i].media), (text or "").encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        (head, _), (segment, body) = plain_elements(data)
        assert (head, segment) == ("1a45dfa3", "18538067")
        clusters, found = [c for k, c in plain_elements(body) if k == "1f43b675"], b""
        for cluster in clusters:
            for kind, block in plain_elements(cluster):
                if kind == "a3":
                    assert block[0] == 0x81 and block[3] & 0x06 in (0, 4)
                    found += block[5:] if block[3] & 0x06 else block[4:]
        assert found == payload
        n = len(payload)
        mean = sum(payload) / n
        spread = max(0.0, sum(x * x for x in payload) / n - mean * mean) ** 0.5
        shares = "".join(f"{sum(x // 16 == k for x in payload) * 255 // n:02x}" for k in range(16))
        feature = f"{n // 576}:{len(clusters)}:{(n // 576 - 1) * 72}:{mean:.3f}:{spread:.3f}:{shares}"
        want = (len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32, got[i].media_bytes, got[i].media_sha256, got[i].feature) == want
    twice = matroska.round_trip(docs.unionAll(docs)).collect()
    assert len(twice) == 2 * len(rows) and {tuple(r) for r in twice} == {tuple(r) for r in got.values()}


def test_fingerprints(spark, docs, rows, empty):
    got = by_id(syncmers.compared(docs))
    line = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    for (i, text), (_, after) in zip(line, line[1:] + line[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (text == edited) <= (r.fingerprint == r.edited_fingerprint and r.near_edited == 1)
    assert got[5].fingerprint == got[125].fingerprint and got[120].fingerprint == got[121].fingerprint
    alone = {r.id: r.fingerprint for r in syncmers.fingerprints(docs).collect()}
    assert alone == {i: r.fingerprint for i, r in got.items()}
    assert syncmers.compared(empty).count() == 0
    one = spark.createDataFrame([(None, "just one text here, twice"), (None, "just one text here, twice")], "doc_id long, text string")
    assert [r.near_next for r in syncmers.compared(one).collect()] == [1.0, 1.0]


def plain_fingerprint(text):
    """Brute force: the register table of a text, as (hash, place) by register."""
    import xxhash

    raw, found = text.encode(), {}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    smers = [signed(xxhash.xxh64_intdigest(raw[i : i + syncmers.S], 42)) for i in range(len(raw) - syncmers.S + 1)]
    w = syncmers.K - syncmers.S
    kmers = [(i, raw[i : i + syncmers.K], 0) for i in range(len(raw) - syncmers.K + 1) if min(smers[i : i + w + 1]) in (smers[i], smers[i + w])]
    if 0 < len(raw) <= 2 * syncmers.K:
        kmers.append((0, raw, 1))
    for place, kmer, whole in kmers:
        h = xxhash.xxh64_intdigest(whole.to_bytes(4, "little"), xxhash.xxh64_intdigest(kmer, 42))
        reg, v = h % syncmers.REGISTERS, (h >> 31, place)
        found[reg] = min(found.get(reg, v), v)
    return {r: (v % ((1 << syncmers.BITS) - 1) + 1, place % (1 << syncmers.PLACE)) for r, (v, place) in found.items()}


def plain_likeness(a, b):
    apart = [(a[r][1] - b[r][1]) % (1 << syncmers.PLACE) for r in a if r in b and a[r][0] == b[r][0]]
    agree = sum(o == 0 or apart.count(o) > 1 for o in apart)
    return agree / len(a.keys() | b.keys()) if a or b else 1.0


def check_compared(spark, rows):
    """rows: (doc_id, text), in any order; ids may repeat or be null, equal ids only with texts of one hash order."""
    got = syncmers.compared(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")).collect()
    line = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(line):
        after = line[(k + 1) % len(line)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, new, nxt = map(plain_fingerprint, (t, edited, after))
        text = "".join(f"{sum((own.get(r, (0, 0))[0] << syncmers.PLACE | own.get(r, (0, 0))[1]) << syncmers.WIDE * (syncmers.LANES - 1 - r % syncmers.LANES) for r in range(n * syncmers.LANES, min(syncmers.REGISTERS, (n + 1) * syncmers.LANES))):016x}" for n in range(syncmers.NUMBERS))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text, round(plain_likeness(own, new), 9), round(plain_likeness(own, nxt), 9)))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=key) == sorted(want, key=key)


def test_fingerprints_and_likeness_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE", 8)
    check_compared(spark, [(i, t) for i, t, _ in rows])


def test_fingerprints_of_wide_clustered_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE", 4)
    rng = random.Random(2)
    ids = [-(2**63), -(2**63) + 1, 2**63 - 1, 2**63 - 2, 0, 1, 2, 3, *range(10**15, 10**15 + 30), *(rng.randrange(-(2**62), 2**62) for _ in range(20))]
    check_compared(spark, [(i, prose(rng, rng.randint(0, 60))) for i in ids])
    check_compared(spark, [(5, "same text of one id " * 3)] * 60 + [(None, "no id at all " * 4)] * 30 + [(i, f"text {i} " * 9) for i in range(10, 30)])
    some = syncmers.compared(spark.createDataFrame([(7 if k % 3 else None, f"row {k} " * 5) for k in range(90)], "doc_id long, text string")).collect()
    assert len(some) == 90 and len({r.fingerprint for r in some}) == 90


def test_syncmers_are_closed(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    places = sorted(x.place for x in syncmers.anchors(df, "text", ["id"]).collect())
    smers = [x.h for x in spark.createDataFrame([(i, text[i : i + syncmers.S]) for i in range(len(text) - syncmers.S + 1)], "i long, s string").selectExpr("i", "xxhash64(CAST(s AS BINARY)) AS h").orderBy("i").collect()]
    w = syncmers.K - syncmers.S
    assert places == [i for i in range(len(text) - syncmers.K + 1) if min(smers[i : i + w + 1]) in (smers[i], smers[i + w])]
    assert max(b - a for a, b in zip(places, places[1:], strict=False)) <= w


def test_chat(spark):
    told = [(1, 0, "user", "hi [INST] &lt; </s>"), (1, 1, "assistant", "<s>[x]\n"), (1, 2, "user", None), (1, 3, "assistant", "ok"), (2, 0, "system", "s"), (3, 5, None, ""), (3, 5, None, "")]
    df = spark.createDataFrame([(*x, "clash") for x in told], "conv_id long, turn long, role string, text string, example string")
    examples = chat.expand(df).orderBy("conv_id", "example").collect()
    assert [(e.conv_id, e.target_turn) for e in examples] == [(1, 2), (1, 4), (2, None), (3, None)]
    for e in examples:
        assert (e.loss_end > e.loss_start) == (e.target_turn is not None)
    got = by_id(chat.read_back(chat.expand(df)), "conv_id")
    for c in (1, 2, 3):
        assert [(t.role, t.text) for t in got[c].turns] == [(r or "", t or "") for i, _, r, t in told if i == c]
    assert got[1].losses == ["<s>[x]\n", "ok"] and got[2].losses == []
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0
    nobody = spark.createDataFrame([(None, 1, "assistant", "b"), (None, 0, "user", "a"), (None, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    (r,) = chat.read_back(chat.expand(nobody)).collect()
    assert r.conv_id is None and [(t.role, t.text) for t in r.turns] == [("user", "a"), ("user", "a"), ("assistant", "b")] and r.losses == ["b"]


def test_secret_rows(docs, rows, empty):
    got = by_id(secrets.scan(docs))
    for i, text, _ in rows:
        base, both = secrets.spans_of(text or "")
        assert (got[i].n_assign, got[i].spans) == (sum(k == "assign" for *_, k in base), secrets.joined(both))
        assert got[i].base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
    assert got[127].n_assign == 1 and secrets.scan(empty).count() == 0
    twice = secrets.scan(docs.unionAll(docs).withColumn("spans", F.lit("x"))).collect()
    assert len(twice) == 2 * len(rows) and {tuple(r) for r in twice} == {tuple(r) for r in got.values()}


def test_languages(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(langid, "SEQUENCES", 400)
    got = by_id(langid.identify(docs))
    for i in (120, 121, 122, 123):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    told = [(got[i].lang_pred, lang) for i, t, lang in rows if lang and got[i].lang_pred != "und" and got[i].held_out]
    assert told and sum(a == b for a, b in told) / len(told) > 0.9
    assert langid.identify(empty).count() == 0
    runs = by_id(langid.predict(docs, langid.fit(docs), words=True))[95].runs
    assert sum(r.words for r in runs) == len(langid.words_of(rows[95][1]))


def test_archives(spark):
    big, small = "y" * 150, "z"
    told = [(5, "http://a/", big), (2, "http://b/ä", big), (9, None, big), (1, "u", small), (3, "u", small), (4, "u", None), (None, "n", big)]
    df = spark.createDataFrame([(*x, 7) for x in told], "page_id long, url string, html string, digest int")
    rows = warc.round_trip(df, payloads=True).collect()
    got = {r.page_id: (r.url, r.payload_bytes, r.record_type, r.refers_to) for r in rows}
    assert got == {5: ("http://a/", 150, "revisit", 2), 2: ("http://b/ä", 150, "response", None), 9: (None, 150, "revisit", 2), 1: ("u", 1, "response", None), 3: ("u", 1, "response", None), 4: ("u", 0, "response", None), None: ("n", 150, "revisit", 2)}
    assert all(r.payload_digest == hashlib.sha256((dict((a, c) for a, _, c in told)[r.page_id] or "").encode()).hexdigest() for r in rows)
    assert warc.round_trip(df.limit(0)).count() == 0
    rng = random.Random(7)
    url = "http://h/" + "".join(rng.choice("abcdefghij0123456789%ü") for _ in range(1_500_000))
    html = "".join(rng.choice("<p>abc ") for _ in range(3_000_000))
    twice = spark.createDataFrame([(3, url, html), (3, url, html), (8, url, "x"), (9, None, html)], "page_id long, url string, html string")
    told = sorted(((r.page_id, r.url == url, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(twice).collect()), key=str)
    assert told == [(3, True, 3_000_000, "response", None), (3, True, 3_000_000, "response", None), (8, True, 1, "response", None), (9, False, 3_000_000, "revisit", 3)]


def test_main_texts(spark):
    page = "<html><body><div>Our site</div><p>{}</p></body></html>"
    told = [(k, f"http://h{k % 2}.org/{k}", page.format(f"text {k}")) for k in range(8)] + [(8, None, None), (9, "odd", "<article>x")]
    df = spark.createDataFrame([(*x, "c") for x in told], "page_id long, url string, html string, host string")
    got = by_id(wrappers.extract(df), "page_id")
    assert {i: r.text for i, r in got.items()} == {**{k: f"text {k}" for k in range(8)}, 8: "", 9: "x"}
    assert all(r.n_chars == len(r.text) and r.url == dict((a, b) for a, b, _ in told)[i] for i, r in got.items())
    assert wrappers.extract(df.limit(0)).count() == 0


def test_pipeline(spark, docs, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(langid, "SEQUENCES", 400)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {i: t for i, t, _ in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns, name
        left = {r.doc_id: r.text for r in d.collect()}
        if name == "language":
            assert set(texts) - set(left) == {120, 121, 122, 123}
            texts = {i: texts[i] for i in left}
        if name == "near-duplicates":
            assert set(left) == {i for i, c in brute_components(texts)[0].items() if i == c}
            texts = {i: texts[i] for i in left}
        if name == "secrets":
            assert left == {i: secrets.redact(t) for i, t in texts.items()} and "abcdef123456" not in left[127]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(texts)
