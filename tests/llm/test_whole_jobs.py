"""Cases in which a part of the job was once left out."""

import itertools
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest

from spanloom.llm import langid, wrappers
from spanloom.plans.session import ship

DOCS = "doc_id long, text string, lang string"


def test_texts_in_many_languages_stay(spark):
    ship(spark)
    langs = ["aa", "bb", "cc", "dd"]
    letters = dict(zip(langs, ("abc", "def", "ghi", "jkl"), strict=True))
    rng = np.random.default_rng(2)
    words = lambda lang, n: " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(n))
    model = langid.train([(lang, words(lang, 60)) for lang in langs for _ in range(6)])
    rows = [(1, " ".join(words(lang, 25) for lang in langs), None), (2, words("aa", 30), None), (3, "12", None), (4, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.score for r in langid.predict(docs, model).collect()}[1] < 0.4
    assert {r.doc_id for r in langid.accepted(docs, model).collect()} == {1, 2}


def test_texts_stay_when_no_model_can_be_fitted(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "some words", None), (2, "99", None), (3, None, None)], DOCS)
    for model in (langid.train([]), langid.train([("aa", "one two"), ("bb", "1"), ("cc", "2")])):
        assert not model.fitted
        assert {r.doc_id for r in langid.accepted(docs, model).collect()} == {1}


def similarity(a, b, width):
    x, y = ({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_the_stage_links_by_five_words(spark):
    ship(spark)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {0: " ".join(base)}
    for k, places in enumerate(([60], [30, 60, 90], [10, 60, 110], [20, 50, 80, 100]), 1):
        texts[k] = " ".join(f"x{k}" if i in places else w for i, w in enumerate(base))
    between = {i for i in texts if i and similarity(texts[0], texts[i], 5) < 0.8 <= similarity(texts[0], texts[i], 4)}
    assert between
    label = {i: i for i in texts}
    for _ in texts:
        for a, b in itertools.combinations(texts, 2):
            if similarity(texts[a], texts[b], 5) >= 0.8:
                label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert left == {i for i in texts if label[i] == i} and between <= left


def test_wrappers_take_all_distinct_pages(spark):
    ship(spark)
    page = "<html><body><div>Our site</div><div>{}</div><p>{}</p></body></html>"
    rows = [(k, "http://copies/", page.format("a", "b")) for k in range(7)]
    rows += [(100 + k, "http://many/", page.format("Winter" if k % 30 == 29 else "Summer", f"text {k}")) for k in range(90)]
    rows += [(200 + k, "http://long/", page.format("x", f"text {k} " + "y" * 100_001)) for k in range(3)]
    rows += [(300 + k, "http://wide/", "<body>" + "".join(f"<p>fixed {i}</p>" for i in range(2100)) + f"<p>text {k}</p></body>") for k in range(2)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[k] for k in range(7)} == {"Our site\na\nb"}
    assert all(got[100 + k] == ("Winter" if k % 30 == 29 else "Summer") + f"\ntext {k}" for k in range(90))
    assert all(got[200 + k] == f"text {k} " + "y" * 100_001 for k in range(3))
    assert all(got[300 + k] == f"text {k}" for k in range(2))


def test_wrappers_of_wrappers_read_their_pages():
    pages = [f"<body><h1>Site</h1><ul>{'<li>x</li>' * (k % 4 + 1)}</ul>{'<b>new</b>' * (k % 3 == 0)}<p>text {k}</p></body>" for k in range(24)]
    streams = [wrappers.as_wrapper(wrappers.scan(p).tokens) for p in pages]
    parts = [wrappers.infer(pages[k : k + 6]) for k in range(0, 24, 6)]
    whole = parts[0]
    for p in parts[1:]:
        whole = wrappers.generalise(whole, p)
    assert all(wrappers.reads(whole, s, 0) == len(s) for s in streams)
    assert len(wrappers.fixed_texts(whole)) == 1


def test_extraction_equals_the_same_rules_without_spark(spark):
    """Brute force: the wrapper of each host from its distinct pages in one loop, then every page by it."""
    from tests.llm.test_cores import host_guide, made_pages

    ship(spark)
    rows, want = [], {}
    for h, tags in enumerate([("nav", "aside", "article", "ad", "footer"), ("div", "p", "div", "ad", "div")]):
        pages, texts = made_pages(h, tags)
        guide = host_guide(pages)
        for k, p in enumerate(pages * 2):
            rows.append((100 * h + k, f"https://u@H{h}.example:80/{k}?q", p))
            want[100 * h + k] = texts[k % 12]
            assert wrappers.main_text(p, guide) == texts[k % 12]
    rows += [(900, None, None), (901, None, "<p>x"), (902, "", "<p>x"), (902, "", "<p>x"), (None, "http://one/", "<nav>m</nav><p>y")]
    got = wrappers.extract(spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, content string, alike int")).collect()
    assert {r.page_id: r.text for r in got} == want | {900: "", 901: "x", 902: "x", None: "y"} and len(got) == len(rows)
    assert all(r.by_wrapper == (r.page_id is not None and r.page_id < 900) for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "one two three four five six seven", "en")] * 3 + [(2, None, None), (3, "", "en"), (4, "12 34 !", None), (None, "alpha beta gamma delta epsilon zeta", "en"), (5, "word " * 30_000, "en")]])
def test_pipeline_of_empty_and_odd_tables(spark, tmp_path, rows):
    ship(spark)
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # without two languages to tell apart all texts with a letter stay; repeated rows of a kept id stay together
    kept = sorted({str(r.doc_id) for r in got})
    assert kept == (sorted(["1", "5", "None"]) if rows else []) and sum(r.doc_id == 1 for r in got) == (3 if rows else 0)
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_pipeline_equals_the_stages_by_brute_force(spark, tmp_path):
    """The rows of run() against plain Python for each stage: links of five-word shingles, redaction, the library's ids."""
    from tokenizers import Tokenizer

    ship(spark)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(60)] for _ in range(6)]
    texts = {}
    for k in range(40):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 8])):
            words[rng.randrange(60)] = word()
        if k % 9 == 0:
            words.insert(5, "password=Zq81xyzTT")
        texts[k] = " ".join(words)
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    label = {i: i for i in texts}
    for _ in texts:
        for a, b in itertools.combinations(texts, 2):
            if similarity(texts[a], texts[b], 5) >= 0.8:
                label[a] = label[b] = min(label[a], label[b])
    library = Tokenizer.from_file(corpus_pipeline.tokenizer("word_bpe_49k.json"))
    want = {}
    for i in (i for i in texts if label[i] == i):
        ids = library.encode(texts[i].replace("password=Zq81xyzTT", "[SECRET]"), add_special_tokens=False).ids + [1]
        want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    got = {r.doc_id: (r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
