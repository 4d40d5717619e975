"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a run of at least WINDOW characters of the base64 alphabets. The counts of a
window change by one character in and one out, and the sum of c*log2(c) and the numbers of
lower, upper, digit, hex and mark characters are kept beside them, so a step costs a few
look-ups whatever the window. What characters a window holds is its class, and each
class has a threshold of its own: sixteen hex digits can't have the entropy of mixed letters.
As windows have the class and not candidates, a name before a value changes nothing. Strings that
are likely no secrets - numbers, dates, UUIDs, words - are allowed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import text_of

#: Classes of a window and the entropy, in bits a character, from which it counts; digits alone never do.
THRESHOLD = {"hex": 3.0, "lower": 3.6, "upper": 3.6, "letters": 3.6, "lower_digits": 3.4, "upper_digits": 3.4, "mixed": 3.6}
#: The base patterns and the classes, in the order in which kinds are listed.
BASE = ("assign", "access", "hex")
KINDS = BASE + tuple(f"entropy_{c}" for c in THRESHOLD)
ORDER = {k: i for i, k in enumerate(KINDS)}
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api")
#: The method's own parameters.
WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{%d,}" % WINDOW)
#: Strings of high entropy that are no secrets: UUIDs, dates and times, numbers; and words, numbers and marks in turn.
ALLOWED = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9TZ+_-]*|[0-9+/=_-]+")
JOINED = re.compile(r"(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4})(?:[/_=+-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4}))*[/_=+-]*|[/_=+-]+")
LETTERS = re.compile(r"[A-Za-z]+")
#: Groups of letters that are one sound; a word's case; and what a word has: vowels, and no long run of consonants.
SOUNDS = re.compile(r"sch|[cpstw]h|gh|ck|ng|tz|qu|st|[b-df-hj-np-tv-z](?=e[lnr])")
SILENT = re.compile(r"(?<=[aeiou])h(?=[lmnrt])")
CASE = re.compile(r"[a-z]+|[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]{2,5}[a-z]+")
HARD = re.compile(r"[b-df-hj-np-tv-xz]{5}")
VOWELS = re.compile(r"[aeiouy]")
LOGS = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the fixed patterns, leftmost and without overlap per kind."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in WORDS):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def is_word(letters: str) -> bool:
    """Whether letters can be read: as a short abbreviation, or with vowels and no hard run of consonants."""
    if len(letters) < 6:
        return True
    low = SOUNDS.sub("t", SILENT.sub("", letters.lower()))
    return CASE.fullmatch(letters) is not None and len(VOWELS.findall(low)) >= 0.24 * len(low) - 0.5 and HARD.search(low) is None


def is_allowed(run: str) -> bool:
    """Whether run is a number, a date, a UUID, or made of words."""
    if ALLOWED.fullmatch(run):
        return True
    return JOINED.fullmatch(run) is not None and all(map(is_word, LETTERS.findall(run)))


#: Numbers of (lower, upper, digit, hex digit, mark) that each character counts for; hex holds both cases.
COUNTED = {c: (c.islower(), c.isupper(), c.isdigit(), c in "0123456789abcdefABCDEF", not c.isalnum()) for c in map(chr, range(128))}


def class_of(lower: int, upper: int, digit: int, hexes: int, mark: int) -> str | None:
    """The class of a window by what it holds; None for digits and marks alone."""
    if not (lower or upper):
        return None
    if hexes == lower + upper + digit + mark and digit and not (lower and upper):
        return "hex"
    if mark or (lower and upper and digit):
        return "mixed"
    if not digit:
        return "letters" if lower and upper else "lower" if lower else "upper"
    return "lower_digits" if lower else "upper_digits"


def hot_windows(run: str, thresholds: dict[str, float] | None = None) -> Iterator[tuple[int, int, str]]:
    """(start, end, class): windows of run whose entropy reaches the threshold of their class, joined where they touch."""
    thresholds = THRESHOLD if thresholds is None else thresholds
    counts: dict[str, int] = {}
    held = [0, 0, 0, 0, 0]
    total, top = 0.0, math.log2(WINDOW)
    open_: dict[str, list[int]] = {}
    for i, c in enumerate(run):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += LOGS[k + 1] - LOGS[k]
        for j, n in enumerate(COUNTED[c]):
            held[j] += n
        if i >= WINDOW:
            k = counts[gone := run[i - WINDOW]]
            counts[gone] = k - 1
            total += LOGS[k - 1] - LOGS[k]
            for j, n in enumerate(COUNTED[gone]):
                held[j] -= n
        if i >= WINDOW - 1 and (of := class_of(*held)) is not None and top - total / WINDOW >= thresholds[of]:
            first = i - WINDOW + 1
            if of in ("lower", "upper", "letters") and is_word(run[first : i + 1]):
                continue
            if of in open_ and first <= open_[of][1]:
                open_[of][1] = i + 1
            else:
                if of in open_:
                    yield *open_[of], of
                open_[of] = [first, i + 1]
    for of, (start, end) in open_.items():
        yield start, end, of


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that the entropy of a window gives away, allow-listed strings left out."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if not is_allowed(run):
            found += [(m.start() + a, m.start() + b, f"entropy_{of}") for a, b, of in hot_windows(run) if not is_allowed(run[a:b])]
    return found


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: an entropy span that lies within one base span is no news.

    One sweep in the order of starts: of the base spans that have begun, the one that ends last
    tells whether any holds an entropy span.
    """
    order = lambda x: (x[0], ORDER[x[2]], x[1])
    both, far = [], -1
    base = sorted(base_spans(text), key=order)
    for x in sorted(base + entropy_spans(text), key=order):  # base kinds come first at one start
        if x[2] in BASE:
            far = max(far, x[1])
        elif x[1] <= far:
            continue
        both.append(x)
    return base, both


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the secrets of every whole text.

    A map over rows without a shuffle. A null text counts as empty, a text of any length is read
    whole; equal rows give equal rows; overlapping spans are all listed, at one start by kind;
    an empty table gives none; other columns, whatever their names, are ignored.
    """

    def scanned(batches):
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for text in batch.column(1).to_pylist():
                base, both = spans_of(text)
                for of, kind in zip(counts, BASE, strict=True):
                    of.append(sum(k == kind for _, _, k in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(both))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """text with every span replaced; overlapping spans become one mark."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in spans_of(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redacted(docs: DataFrame, text_column: str = "text", chars_column: str = "n_chars") -> DataFrame:
    """docs, all columns, with secrets replaced in the text and its length set anew. No shuffle.

    A null text stays null and keeps its length; an empty one stays empty. Overlapping spans
    become one mark. Repeated rows stay repeated, an empty table empty; other columns are kept,
    whatever their names.
    """
    text = docs.columns.index(text_column)
    chars = docs.columns.index(chars_column) if chars_column in docs.columns else -1

    def cleaned(batches):
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            texts = [redact(t) for t in batch.column(text).to_pylist()]
            cols = list(batch.columns)
            cols[text] = pa.array(texts, pa.string())
            if chars >= 0:
                old = batch.column(chars).to_pylist()
                cols[chars] = pa.array([n if t is None else len(t) for t, n in zip(texts, old, strict=True)], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(cleaned, docs.schema)
