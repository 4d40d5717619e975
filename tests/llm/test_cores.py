"""The operators' cores against the libraries, brute force and round trips, without Spark."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanloom.llm import bpe, dedup, langid, matroska, packing, secrets, warc, wrappers

ODD = ["'", "s", "t", "re", " ", "  ", "\n", "\t", "a", "É", "1", "²", ".", ",", "<|endoftext|>", "\x1c", "\x85", "\xa0", "漢", "😀", "ll", "'ve", "́", "ab", "-", "The", "İ", "ß", "Σ", "ſ"]
texts = st.lists(st.sampled_from(ODD), max_size=120).map("".join)
BYTE, WORD = (Tokenizer.from_file(public_tokenizers.path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k"))
ENCODER = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture
def small_chunks(monkeypatch):
    for name, value in (("MASK", 7), ("LEAST", 4), ("HEAD", 4)):
        monkeypatch.setattr(bpe, name, value)
    ENCODER.chunks.clear()
    yield
    ENCODER.chunks.clear()


def test_bpe_equals_the_library_with_many_joins(small_chunks):
    random.seed(1)
    for _ in range(1500):
        text = "".join(random.choice(ODD) for _ in range(random.choice([3, 30, 150])))
        ids = ENCODER.encode(text)
        assert ids == BYTE.encode(text, add_special_tokens=False).ids
        assert ENCODER.decode(ids) == BYTE.decode(ids, skip_special_tokens=False).encode()


@settings(max_examples=200, deadline=None)
@given(texts)
def test_bpe_equals_the_library(text):
    assert ENCODER.encode(text) == BYTE.encode(text, add_special_tokens=False).ids


def test_chunks_are_shared():
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(20000))
    ENCODER.chunks.clear()
    ENCODER.encode("x" * 300 + passage)
    before = len(ENCODER.chunks)
    assert ENCODER.encode("yy zz" * 77 + passage) == BYTE.encode("yy zz" * 77 + passage, add_special_tokens=False).ids
    assert len(ENCODER.chunks) - before <= 3 < before


@settings(max_examples=200, deadline=None)
@given(texts)
def test_word_ids_equal_the_library(text):
    tool = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    assert [x.tolist() for x in tool.ids([text, "", text])] == [WORD.encode(t, add_special_tokens=False).ids for t in (text, "", text)]


def test_word_ids_of_segments_and_odd_texts(monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 40)
    tool = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["Don't STOP. it's 3.14, ok?! " * 9, "x" * 300, "a <|EndOfText|> b <|endoftext|> c", "ΌΣΟΣ İI ǅ ﬁ Ångström", "e\u0301a\xa0b\x85c\x1cd\u3000e", "漢字 かな 한글 " * 8, "", " \t\n", "ÀÉÎ, Öß. ÿŸ", "A.B,C..D,,", "\x00\x01 \x7f"]
    assert [x.tolist() for x in tool.ids(odd)] == [WORD.encode(t, add_special_tokens=False).ids for t in odd]


def fewest(sizes, capacity):
    """Brute force: the least number of bins, by trying every bin for every piece."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_packing_is_optimal_on_small_cases():
    random.seed(3)
    for _ in range(120):
        capacity = random.choice([10, 17, 30])
        sizes = sorted((random.randint(1, capacity) for _ in range(random.randint(1, 9))), reverse=True)
        found = packing.solve(dict(Counter(sizes)), capacity)
        got = Counter()
        for pattern, n in found.items():
            assert sum(s * k for s, k in pattern) <= capacity
            got.update({s: k * n for s, k in pattern})
        assert got == Counter(sizes)
        assert sum(found.values()) == fewest(sizes, capacity)


def test_fillings_come_by_waste_and_leave_out_none():
    rng = random.Random(8)
    for _ in range(60):
        room = rng.randint(5, 20)
        counts = Counter(rng.randint(1, room) for _ in range(rng.randint(1, 7)))
        found = [f for f in packing.fillings(list(counts), counts, room) if f is not None]
        every = {tuple(sorted(c, reverse=True)) for n in range(8) for c in itertools.combinations(counts.elements(), n) if sum(c) <= room}
        assert [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True) and set(found) <= every and len(set(found)) == len(found)
        assert all(any(packing.dominates(f, e) for f in found) for e in every)


def test_packing_beats_best_fit_with_many_pieces_a_sequence():
    rng = random.Random(5)
    missed = 0
    for _ in range(60):
        sizes, bins = [], rng.randint(2, 9)
        for _ in range(bins):
            cuts = sorted(rng.sample(range(1, 50), rng.randint(2, 8)))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 50], strict=True)]
        counts = dict(Counter(sizes))
        found = packing.search(counts, 50)
        missed += sum(packing.best_fit(counts, 50).values()) > bins
        assert (found.sequences, found.bound, found.ended) == (bins, bins, "bound")
    assert missed


def test_the_search_ends_by_its_budget_and_says_so():
    counts = dict(Counter(random.Random(1).choices(range(410, 800), k=3000)))
    short, longer = packing.search(counts, 4096, 0), packing.search(counts, 4096)
    assert short.ended == longer.ended == "budget" and short.bound <= longer.sequences < short.sequences == sum(packing.best_fit(counts, 4096).values())
    one = packing.search({4: 3}, 7)
    assert (one.sequences, one.ended) == (3, "bound") and packing.search({}).sequences == 0


def test_places_hold_every_rank_once():
    counts = {7: 5, 3: 11, 2: 4, 10: 2}
    p = packing.places(packing.solve(counts, 10))
    assert {int(s): int(sum(1 for x in p["length"] if x == s)) > 0 for s in counts} == dict.fromkeys(counts, True)
    for size in counts:
        starts = sorted(int(r) for s, r in zip(p["length"], p["rank"], strict=True) if s == size)
        assert starts[0] == 0 and len(set(starts)) == len(starts)


def test_shingles_and_links():
    assert dedup.words_of("A\x0bbÉ\x1cC  d") == [b"a", "bÉ\x1cc".encode(), b"d"]
    assert len(dedup.shingles("one two three")) == 1 == len(dedup.shingles("a b c d")) and not len(dedup.shingles(" \n"))
    assert (dedup.shingles("A B c d e") == dedup.shingles("a b C d E")).all()
    a, b = np.arange(10, dtype=np.uint64), np.arange(2, 10, dtype=np.uint64)
    assert dedup.linked(a, b, 80) and not dedup.linked(a, b[1:], 80) and not dedup.linked(a[:0], a[:0], 80)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 62, 1000).astype(np.uint64))
    s = dedup.signatures([x, x[:800]])
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15


def forward(scores, step, start):
    """Marginals by listing every path."""
    t, k = scores.shape
    total, out = 0.0, np.zeros((t, k))
    for path in itertools.product(range(k), repeat=t):
        p = np.exp(start[path[0]] + sum(scores[i, s] for i, s in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += p
        for i, s in enumerate(path):
            out[i, s] += p
    return out / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    scores, step, start = rng.normal(size=(1, 6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    assert np.allclose(langid.forward_backward(scores, step, start)[0][0], forward(scores[0], step, start))


def test_field_tells_words_apart_in_mixed_text(monkeypatch):
    monkeypatch.setattr(langid, "SEQUENCES", 600)
    rng = random.Random(4)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(2, 7)))
    rows = [(lang, " ".join(word(s) for _ in range(60))) for lang, s in (("xx", "abcde"), ("yy", "uvwxy")) for _ in range(30)]
    model = langid.train(rows)
    tool = langid.Labeller(model)
    long = [word("abcde") for _ in range(150)] + [word("uvwxy") for _ in range(50)]
    m = tool.marginals([long, ["abba"]])
    assert (m[0].argmax(1) == [0] * 150 + [1] * 50).mean() > 0.97
    assert np.allclose(m[0][:100], langid.forward_backward(model.scores(long)[None], model.step, model.start)[0][0][:100], atol=1e-5)
    assert langid.train([]).langs == [] and langid.train([("xx", "ab")]).langs == ["xx"]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_matroska_round_trip(raw):
    payload = raw + matroska.PAD * (-len(raw) % matroska.PACKET if raw else matroska.PACKET)
    data = matroska.encode(payload)
    parsed = matroska.parse(data)
    assert b"".join(data[a : a + n] for *_, a, n in parsed["packets"]) == payload
    assert [t for _, t, *_ in parsed["packets"]] == [k * 72 for k in range(len(payload) // 576)]


def test_matroska_lacing_and_open_clusters():
    payload = bytes(range(256)) * 2
    xiph = bytes([2, 255, 45, 100]) + payload[:500]
    assert matroska.unlace(xiph, 0, len(xiph), 0x02) == [(4, 300), (304, 100), (404, 100)]
    ebml = bytes([2]) + matroska.size_of(100, 2) + (5 + (1 << 6) - 1 | 1 << 7).to_bytes(1, "big") + payload[:305]
    assert [n for _, n in matroska.unlace(ebml, 0, len(ebml), 0x06)] == [100, 105, 100]
    with pytest.raises(matroska.MatroskaError):
        matroska.unlace(bytes([1]) + payload[:3], 0, 4, 0x04)
    data = matroska.encode(payload + b"\xff" * 64)
    at = data.index(matroska.CLUSTER.to_bytes(4, "big"))
    end = data.index(matroska.CUES.to_bytes(4, "big"))
    _, width = matroska.vint(data, at + 4, False)
    opened = data[: at + 4] + b"\x01" + b"\xff" * 7 + data[width:end]
    seg = data.index(matroska.SEGMENT.to_bytes(4, "big"))
    _, body = matroska.vint(data, seg + 4, False)
    opened = data[: seg + 4] + b"\x01" + b"\xff" * 7 + opened[body:]
    assert len(matroska.parse(opened)["packets"]) == 1
    for bad in (b"", b"\x00", data[:40], data[:at]):
        with pytest.raises(matroska.MatroskaError):
            matroska.parse(bad) if bad != data[:at] else matroska.parse(data[: at + 6])


def test_warc_members_and_errors():
    digest = hashlib.sha256(b"x" * 200).hexdigest()
    one = warc.page_record(1, "http://a/ä b", b"x" * 200, digest, None, False)
    two = warc.page_record(2, None, b"x" * 200, digest, 1, True)
    data = one + two
    rows = list(warc.pages_of(data[i : i + 7] for i in range(0, len(data), 7)))
    assert [(r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows] == [(1, "http://a/ä b", 200, "response", None), (2, None, 200, "revisit", 1)]
    with pytest.raises(warc.WarcError):
        list(warc.pages_of([data[:-3]]))
    raw = zlib.decompress(one, 31)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(warc.WarcError):
        list(warc.pages_of([z.compress(raw.replace(b"xxx", b"xyx", 1)) + z.flush()]))
    with pytest.raises(warc.WarcError):
        list(warc.pages_of([b"no gzip at all"]))


def test_secrets():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'a token = "{key}" b API-key=zzzzzz api_key: q1 AKIA{"A1" * 8} AKIA12 Secret:abcdef'
    base, both = secrets.spans_of(text)
    assert [k for *_, k in base] == ["assign", "hex", "access", "assign"]
    assert text[slice(*base[1][:2])] == key and base == [s for s in both if s in base]
    assert not secrets.spans_of("ordinary words and 123e4567-e89b-12d3-a456-426614174000 and antidisestablishmentarianism 20240101202401012024")[1]
    odd = "see Zq8xVt2LmP0aKd93HsYw7RbN end"
    assert secrets.entropy_spans(odd) and "Zq8x" not in secrets.redact(odd) and secrets.redact(odd).endswith(" end")
    assert secrets.redact(None) is None and secrets.redact("") == ""


def test_incremental_entropy_equals_the_plain_one():
    random.seed(6)
    run = "".join(random.choice("abcdef0123456789XYZ") for _ in range(80))
    plain = [-sum(c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in Counter(run[i : i + secrets.WINDOW]).values()) for i in range(len(run) - secrets.WINDOW + 1)]
    covered = {k for a, b, _ in secrets.hot_windows(run, dict.fromkeys(secrets.THRESHOLD, 3.5)) for k in range(a, b)}
    assert covered == {k for i, h in enumerate(plain) if h >= 3.5 for k in range(i, i + secrets.WINDOW)}


PAGE = '<html><head><title>x</title></head><body><header>Site</header><nav><a>m</a></nav><div id="top">Our site</div>{}<div class="comments"><p>nice</p></div><footer>f</footer></body></html>'


def test_main_text_of_articles():
    page = PAGE.format("<article><h1>A &amp; B</h1><p><b>one\n two<br><p>three&nbsp;four<script>var a='</p>'</script><!-- no --><aside>ad</aside><div class='share'>s</div><article>reader</article></article>")
    assert wrappers.main_text(page) == "A & B\none two\nthree four"
    assert wrappers.main_text("") == "" and wrappers.main_text("plain") == "plain" and wrappers.main_text("<p>a<p>b") == "a\nb"
    assert wrappers.main_text("<p>1 < 2 and <b>x") == "1 < 2 and x"


def test_wrappers_find_slots_groups_and_fixed_texts():
    pages = [PAGE.format("".join(f"<p>{k} {i}</p>" for i in range(k))) for k in (2, 3, 5)]
    wrapper = wrappers.infer(pages)
    kinds = {k for k, _ in wrapper}
    assert "rep" in kinds or "opt" in kinds
    fixed = set(wrappers.fixed_texts(wrapper))
    for p in pages:
        assert wrappers.reads(wrapper, wrappers.as_wrapper(wrappers.scan(p).tokens), 0) > 0
    assert wrappers.main_text(pages[0], wrappers.Guide(fixed=frozenset(fixed))) == "2 0\n2 1"
    assert wrappers.main_text(pages[0]) == "Our site\n2 0\n2 1"
    assert wrappers.infer(pages[:1]) == []


def host_guide(pages):
    found = None
    for p in sorted(set(pages)):
        found = wrappers.found_in(p) if found is None else found.joined(wrappers.found_in(p))
    return found.guide()


def made_pages(seed, tags):
    """Pages of one host and their main texts: a menu, a notice now and then, an article with adverts of its own, a footer."""
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randrange(99)) for _ in range(n))
    menu, notice, article, advert, footer = tags
    pages, texts = [], []
    for k in range(12):
        blocks = [prose(rng.randint(4, 40)) for _ in range(rng.randint(1, 6))]
        inner = "".join(f"<p>{b}</p>" + (f'<div class="{advert}">{prose(3)}</div>' if i == 0 else "") for i, b in enumerate(blocks))
        top = f"<{notice}>{prose(3)}</{notice.split()[0]}>" if k % 4 == 1 else ""
        pages.append(f"<html><body><{menu}><ul>{''.join(f'<li><a>{prose(1)}</a></li>' for _ in range(4))}</ul></{menu}>{top}<{article}><h1>{prose(3)}</h1>{inner}<h4>Share this</h4></{article}><{footer}>{prose(4)}</{footer}></body></html>")
        title = re.search("<h1>(.*)</h1>", pages[-1])[1]
        texts.append("\n".join([title, *blocks]))
    return pages, texts


@pytest.mark.parametrize("tags", [("nav", "aside", "article", "ad", "footer"), ("div", "p", "div", "ad", "div"), ("section", "div", "section", "promo-box", "section")])
def test_the_wrapper_tells_the_content_of_unnamed_elements(tags):
    pages, texts = made_pages(3, tags)
    guide = host_guide(pages)
    assert guide.content and [wrappers.main_text(p, guide) for p in pages] == texts


def test_named_elements_go_only_where_the_wrapper_confirms_them():
    page = '<body><article><h1>{0}</h1><p>text {0} {0} {0}</p>{1}<p>more {0}</p></article></body>'
    pages = [page.format(k, '<div class="notice-of-meeting">at nine</div>' if k == 1 else f'<div class="share">s{k}</div>') for k in range(5)]
    guide = host_guide(pages)
    assert wrappers.main_text(pages[1], guide) == "1\ntext 1 1 1\nat nine\nmore 1"
    assert wrappers.main_text(pages[2], guide) == "2\ntext 2 2 2\nmore 2" == wrappers.main_text(pages[2])
    assert wrappers.main_text(pages[1]) == "1\ntext 1 1 1\nmore 1"


def test_copies_and_near_copies_keep_their_text():
    page = "<body><div>menu</div><article><h1>Same</h1><p>the same text on all of them</p>{}</article></body>"
    assert host_guide([page.format("")] * 3) is None
    near = [page.format(k) for k in ("x", "y", "z")]
    assert [wrappers.main_text(p, host_guide(near)) for p in near] == [f"Same\nthe same text on all of them\n{k}" for k in "xyz"]
    odd = ["", "<p>a", "<div><div><div>", "</div></p>", "<article></article>x", "plain & text"]
    guide = host_guide(odd)
    assert [bool(wrappers.main_text(p, guide)) for p in odd] == [False, True, False, False, True, True]


def test_words_of_scripts_and_long_runs():
    assert langid.words_of("Don't 3abc_dÉf") == ["don", "t", "abc", "déf"]
    assert langid.words_of("приветworld 漢字かなカナ") == ["привет", "world", "漢字", "かな", "カナ"]
    run = "".join(chr(0x4E00 + k) for k in range(60))
    assert "".join(langid.words_of(run)) == run and len(langid.words_of(run)) == 3
    assert "".join(langid.words_of("x" * 100 + " y")) == "x" * 100 + "y"
    other = run[:30] + "".join(chr(0x5000 + k) for k in range(30))
    assert langid.words_of(run)[2] != langid.words_of(other)[2]
    long = "abcdefghijklmnopqrstuvwx"
    assert set(langid.features_of(long, {})) != set(langid.features_of(long[:18] + "zyxwvx", {}))


def test_language_rows_equal_the_plain_computation(monkeypatch):
    """Brute force: marginals of every word by enumeration over a chain, then means."""
    rows = [("a", "the cat and the dog went out " * 6), ("b", "der hund und die katze gingen raus " * 6)] * 8
    monkeypatch.setattr(langid, "SEQUENCES", 400)
    model = langid.train(rows)
    text = "the hund and die"
    words = langid.words_of(text)
    scores = model.scores(words)
    weights = {}
    for path in itertools.product(range(2), repeat=len(words)):
        total = model.start[path[0]] + sum(scores[i, c] for i, c in enumerate(path)) + sum(model.step[x, y] for x, y in itertools.pairwise(path))
        weights[path] = math.exp(total)
    z = sum(weights.values())
    mean = [sum(w * sum(c == k for c in p) for p, w in weights.items()) / z / len(words) for k in range(2)]
    ((_, answer, score, _),) = langid.answers(langid.Labeller(model), [text])
    assert answer == [model.langs[int(np.argmax(mean))]] and abs(score[0] - max(mean)) < 1e-4


def plain_base(text):
    """Brute force: the three fixed patterns, character by character."""
    found, ascii_, word = [], "abcdefghijklmnopqrstuvwxyz", set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")
    low = "".join(ascii_[ord(c) - 65] if "A" <= c <= "Z" else c for c in text)
    at = 0
    while at < len(text):
        end = 0
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(name, at):
                continue
            k = at + len(name)
            k += text[k : k + 1] in ("'", '"') and k < len(text)
            while text[k : k + 1] == " ":
                k += 1
            if text[k : k + 1] not in (":", "="):
                continue
            k += 1
            while text[k : k + 1] == " ":
                k += 1
            quote = k + (text[k : k + 1] in ("'", '"') and k < len(text))
            stop = quote
            while stop < len(text) and text[stop] in word:
                stop += 1
            if stop > quote:
                end = stop
                if stop - quote >= 6:
                    found.append((at, stop, "assign"))
                break
        at = max(end, at + 1)
    for kind, head, allowed, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            stop = at + len(head)
            while stop < len(text) and text[stop] in allowed:
                stop += 1
            if not text.startswith(head, at) or stop == at + len(head):
                at += 1
                continue
            if stop - at >= least:
                found.append((at, stop, kind))
            at = stop
    return found


@given(st.lists(st.sampled_from(["password", "PassWd", "secret", "token", "api_key", "APIKEY", "api", '"', "'", " ", "  ", ":", "=", "abc123", "x.y-z", "AKIA", "AKIA" + "Z9" * 9, "0123456789abcdef", "deadbeef", "\n", "é", "ſecret", "\u00a0", "K"]), max_size=14).map("".join))
def test_base_spans_equal_brute_force(text):
    base, both = secrets.spans_of(text)
    order = lambda x: (x[0], ("assign", "access", "hex").index(x[2]))
    assert base == sorted(plain_base(text), key=order)
    more = [x for x in secrets.entropy_spans(text) if not any(a <= x[0] and x[1] <= b for a, b, _ in base)]
    assert both == sorted([*base, *more], key=lambda x: (x[0], secrets.ORDER[x[2]], x[1]))


def test_classes_of_windows_and_allowed_strings():
    random.seed(9)
    made = lambda alphabet, n, before="": before + "".join(random.choice(alphabet) for _ in range(n))
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    told = {"hex": made("0123456789ABCDEF", 40, "KEY="), "letters": made(low + up, 40), "lower_digits": made(low + digits, 30), "upper_digits": made(up + digits, 30), "mixed": made(low + up + digits, 30), "lower": made("bcdfghjklmnpqrstvwxyz", 40), "upper": made("BCDFGHJKLMNPQRSTVWXYZ", 40)}
    for of, run in told.items():
        assert f"entropy_{of}" in {k for *_, k in secrets.entropy_spans(f"a {run} b")}, of
        assert run.removeprefix("KEY=") not in secrets.redact(f"a {run} b")
    words = "internationalization-and-localization some/path/to/a/long/file_name_2024 CamelCaseClassNameFactoryImpl thisisaverylongwordwithoutspaces Rechtschreibreformbefuerworter Donaudampfschifffahrtsgesellschaft http-strict-transport-security-header 550e8400-e29b-41d4-a716-446655440000 2024-03-12T10:11:12Z ------------------------"
    assert not secrets.spans_of(words)[1]
    blob = "password=abc123 " * 20_000 + " ".join(made(low + up + digits, 40) for _ in range(4000))
    base, both = secrets.spans_of(blob)
    assert len(base) == 20_000 and len(both) >= 24_000


def test_overlapping_spans_become_one_mark():
    text = "x token=0123456789abcdef0123456789abcdef-rest y"
    assert len(secrets.spans_of(text)[0]) == 2 and secrets.redact(text) == "x [SECRET] y"
