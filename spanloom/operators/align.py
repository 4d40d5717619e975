"""Alignment of an observed text to a reference: anchors, chains and banded dynamic programs.

Grams that are unique on both sides are found relationally; what is left between the anchors
of a pair is small, so a pair is one row and its chain and programs run in one Arrow function.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the scoring: equal characters, sound-alikes, others, a skipped reference or observed character, segments apart.
MATCH, PHONETIC, MISMATCH, DELETE, INSERT, APART = 2.0, 1.35, -1.15, -0.75, -0.55, 0.20
EXACT, ALIKE = 1.0, 0.88
#: Fixed values of the search: characters of an anchor, least band and what it exceeds the difference of lengths by, cells of a chunk.
GRAM, BAND, SLACK, CELLS = 4, 32, 24, 280_000


def unique_grams(text: str, width: int = GRAM) -> dict[str, int]:
    seen: dict[str, int] = {}
    for i in range(len(text) - width + 1):
        g = text[i : i + width]
        seen[g] = -1 if g in seen else i
    return {g: i for g, i in seen.items() if i >= 0}


def chain(reference: str, observed: str, width: int = GRAM) -> list[tuple[int, int]]:
    """Anchors (reference, observed): the longest rising chain of shared unique grams, without overlaps."""
    there = unique_grams(observed, width)
    pairs = sorted((i, there[g]) for g, i in unique_grams(reference, width).items() if g in there)
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, q) in enumerate(pairs):
        p = bisect_left(tails, q)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(q)
            at.append(k)
        else:
            tails[p], at[p] = q, k
    rising, k = [], at[-1] if at else -1
    while k >= 0:
        rising.append(pairs[k])
        k = back[k]
    kept: list[tuple[int, int]] = []
    for i, j in reversed(rising):
        if not kept or (i >= kept[-1][0] + width and j >= kept[-1][1] + width):
            kept.append((i, j))
    return kept


@dataclass
class Path:
    """A way through a chunk: its score and its matches (reference, observed, confidence)."""

    score: float
    matches: tuple[tuple[int, int, float], ...]


def similar(a: str, b: str, alike: dict[str, str] | None) -> tuple[float, float]:
    if a == b:
        return MATCH, EXACT
    if alike and a in alike and alike.get(a) == alike.get(b):
        return PHONETIC, ALIKE
    return MISMATCH, 0.0


def two_best(reference: str, observed: str, alike: dict[str, str] | None = None, ours: Sequence[int] = (), theirs: Sequence[int] = ()) -> tuple[Path, Path | None, bool]:
    """The best and second-best path of a chunk, and whether it was split for its size.

    A cell keeps two entries, the higher score first, earlier ones first on ties, in the order
    match, skipped reference character, skipped observed character. ours and theirs number
    the segments of the characters: where both sides have several, a match costs more the
    further apart its segments are, as parts of all.
    """
    n, m = len(reference), len(observed)
    if not n or not m:
        return Path(INSERT * m if not n else DELETE * n, ()), None, False
    band = max(BAND, abs(n - m) + SLACK)
    if (n + 1) * min(m + 1, 2 * band + 3) > CELLS and n > 1 and m > 1:
        half = n // 2
        cut = min(max(round(m * half / n), 1), m - 1)
        a, a2, _ = two_best(reference[:half], observed[:cut], alike, ours[:half], theirs[:cut])
        b, b2, _ = two_best(reference[half:], observed[cut:], alike, ours[half:], theirs[cut:])
        moved = lambda p: tuple((i + half, j + cut, c) for i, j, c in p.matches)
        best = Path(a.score + b.score, a.matches + moved(b))
        seconds = [Path(x.score + y.score, x.matches + moved(y)) for x, y in ((a2, b), (a, b2)) if x and y]
        return best, max(seconds, key=lambda p: p.score, default=None), True
    last_ours, last_theirs = max(ours, default=0), max(theirs, default=0)
    rows: list[dict[int, list]] = []
    for i in range(n + 1):
        mid = round(i * m / n)
        low, high = max(0, mid - band), min(m, mid + band)
        if i == 0:
            low = 0
        if i == n:
            high = m
        row: dict[int, list] = {}
        above = rows[-1] if rows else {}
        for j in range(low, high + 1):
            if not i and not j:
                row[0] = [(0.0, None, 0)]
                continue
            found = []
            if i and j and j - 1 in above:
                s, c = similar(reference[i - 1], observed[j - 1], alike)
                if last_ours and last_theirs:
                    s -= APART * abs(ours[i - 1] / last_ours - theirs[j - 1] / last_theirs)
                found += [(e[0] + s, (i - 1, j - 1, k), c) for k, e in enumerate(above[j - 1])]
            if i and j in above:
                found += [(e[0] + DELETE, (i - 1, j, k), 0.0) for k, e in enumerate(above[j])]
            if j and j - 1 in row:
                found += [(e[0] + INSERT, (i, j - 1, k), 0.0) for k, e in enumerate(row[j - 1])]
            found.sort(key=lambda e: -e[0])
            row[j] = found[:2]
        rows.append(row)

    def trace(k: int) -> Path:
        i, j, out = n, m, []
        score = rows[n][m][k][0]
        while True:
            _, back, confidence = rows[i][j][k]
            if back is None:
                return Path(score, tuple(reversed(out)))
            if confidence > 0:
                out.append((i - 1, j - 1, confidence))
            i, j, k = back

    last = rows[n].get(m, [])
    return trace(0), trace(1) if len(last) > 1 else None, False


@dataclass(frozen=True)
class Aligned:
    """Matches (reference, observed, confidence) in order, the margin by reference position where two ways compete, the least margin, and whether a chunk was split."""

    matches: tuple[tuple[int, int, float], ...] = ()
    margins: tuple[tuple[int, float], ...] = ()
    margin: float = 0.0
    split: bool = False


def aligned(reference: str, observed: str, alike: dict[str, str] | None = None, ours: Sequence[int] = (), theirs: Sequence[int] = ()) -> Aligned:
    """Two normalised texts aligned: anchors first, then each gap between them.

    The margin of a gap is how much its best way is ahead of the second, by twice its matches,
    0 to 1; ways that match alike do not compete. The gap with the least margin gives it to the
    positions in which its two ways differ. Nothing aligned has margin 0.
    """
    if not reference or not observed:
        return Aligned()
    matches: list[tuple[int, int, float]] = []
    margin, split, i, j, unsure = 1.0, False, 0, 0, ()
    for a, b in [*chain(reference, observed), (len(reference), len(observed))]:
        best, second, forced = two_best(reference[i:a], observed[j:b], alike, ours[i:a], theirs[j:b])
        split = split or forced
        matches += [(x + i, y + j, c) for x, y, c in best.matches]
        if second is not None and second.matches:
            one, two = {x: y for x, y, _ in best.matches}, {x: y for x, y, _ in second.matches}
            found = min(1.0, max(0.0, best.score - second.score) / max(1.0, 2.0 * len(best.matches)))
            if one != two and found < margin:
                margin = found
                unsure = tuple(sorted(x + i for x in one.keys() | two.keys() if one.get(x) != two.get(x)))
        if a < len(reference):
            matches += [(a + k, b + k, EXACT) for k in range(GRAM)]
        i, j = min(a + GRAM, len(reference)), min(b + GRAM, len(observed))
    return Aligned(tuple(sorted(matches)), tuple((x, margin) for x in unsure), margin, split)


def line_of(text: str, origin: Sequence[int]) -> list[int]:
    """The number of line ends before each character of a normalised text, whose origins are given."""
    before = list(accumulate((c in "\n\r" for c in text), initial=0))
    return [before[i] for i in origin]


def align_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """key, ref_pos, obs_pos, confidence, margin (of the position: 1 where no other way competes) of pairs (key, reference, observed), row by row.

    If the pairs have arrays ref_segments and obs_segments, matches of distant segments cost more.
    """
    extra = [c for c in ("ref_segments", "obs_segments") if c in pairs.columns]

    def run(batches):
        for pdf in batches:
            rows = []
            for k, a, b, *segments in zip(*(pdf[c] for c in (key, "reference", "observed", *extra)), strict=True):
                found = aligned(a or "", b or "", None, *(list(x) for x in segments))
                margins = dict(found.margins)
                rows += [(k, i, j, c, margins.get(i, 1.0)) for i, j, c in found.matches]
            yield pd.DataFrame(rows, columns=[key, "ref_pos", "obs_pos", "confidence", "margin"])

    return pairs.select(key, "reference", "observed", *extra).mapInPandas(run, f"{key} long, ref_pos long, obs_pos long, confidence double, margin double")


def alignment_margins(pairs: DataFrame, key: str) -> DataFrame:
    """key, matches, margin, split, unsure (positions with a competing way) of pairs (key, reference, observed)."""

    def run(batches):
        for pdf in batches:
            found = [aligned(a or "", b or "") for a, b in zip(pdf["reference"], pdf["observed"], strict=True)]
            yield pd.DataFrame({key: pdf[key], "matches": [len(f.matches) for f in found], "margin": [f.margin for f in found], "split": [f.split for f in found], "unsure": [[x for x, _ in f.margins] for f in found]})

    return pairs.select(key, "reference", "observed").mapInPandas(run, f"{key} long, matches long, margin double, split boolean, unsure array<long>")


def anchor_chains(pairs: DataFrame, key: str) -> DataFrame:
    """key, ref_pos, obs_pos of the anchors of pairs (key, reference, observed)."""

    def run(batches):
        for pdf in batches:
            rows = [(k, i, j) for k, a, b in zip(pdf[key], pdf["reference"], pdf["observed"], strict=True) for i, j in chain(a or "", b or "")]
            yield pd.DataFrame(rows, columns=[key, "ref_pos", "obs_pos"])

    return pairs.select(key, "reference", "observed").mapInPandas(run, f"{key} long, ref_pos long, obs_pos long")
