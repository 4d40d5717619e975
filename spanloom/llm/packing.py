"""Best-fit packing by bin completion.

Lengths are whole numbers from 1 to the capacity, so all that the packing has to know is how
many pieces there are of each length: a table of at most `capacity` rows, however large the
corpus. The solver works on that table and gives patterns - which lengths share a sequence,
and how often - and pieces are then dealt to the places of the patterns by their rank among
the pieces of their length. Ranks are taken in small groups, so that a length that a third of
all pieces have is not sorted in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import text_of, written
from spanloom.llm.memo import Memo, merged

CAPACITY = 4096
SEPARATOR = 1
#: Pieces of one length that are ranked together.
RANKED = 2_000
#: Bound of the search beyond the best-fit solution: lengths and fillings looked at over all nodes.
LENGTHS = 200_000

Pattern = tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Best-fit decreasing on counts: each piece goes to the fullest sequence that takes it."""
    room: dict[int, list[list]] = {}
    rooms: list[int] = []
    closed: Counter = Counter()

    def put(left: int, pattern: Pattern, n: int) -> None:
        if not left:
            closed[pattern] += n
        elif left in room:
            room[left].append([pattern, n])
        else:
            room[left] = [[pattern, n]]
            insort(rooms, left)

    for size in sorted(counts, reverse=True):
        todo = counts[size]
        while todo:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                put(capacity, (), -(-todo // (capacity // size)))
                continue
            left = rooms[k]
            pattern, n = room[left][-1]
            fits = min(left // size, todo)
            full = min(n, todo // fits)
            room[left][-1][1] -= full
            if not room[left][-1][1]:
                room[left].pop()
                if not room[left]:
                    del room[left], rooms[k]
            put(left - fits * size, (*pattern, (size, fits)), full)
            todo -= full * fits
    for left in rooms:
        for pattern, n in room[left]:
            if pattern:
                closed[pattern] += n
    return dict(closed)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and the bounds by large pieces, which cannot share.

    For each k: pieces over capacity - k share with none of k or more, pieces over half the
    capacity not with each other, and the rest has to fit beside the latter.
    """
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    number, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * np.arange(capacity + 1))])
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    top = capacity - k + 1
    mid = number[top] - number[half + 1]
    free = mid * capacity - (volume[top] - volume[half + 1])
    small = volume[half + 1] - volume[k]
    return int((number[-1] - number[half + 1] + np.maximum(0, -(-(small - free) // capacity))).max())


def fillings(sizes: list[int], counts: dict[int, int], room: int) -> Iterator[tuple[int, ...] | None]:
    """Undominated sets of pieces that fit into room, least waste first, as they are asked for.

    None stands for a dominated one, so that who asks can stop.

    A set is dominated if another can hold its pieces one by one or several in one. `within[k]`
    has a bit for every sum that the sizes from the k-th on can have, so for each waste in
    turn only sets with just that sum are built, large pieces first: what is dominated comes
    after what dominates it.
    """
    order = sorted((s for s in sizes if s <= room), reverse=True)
    full = (1 << (room + 1)) - 1
    within = [1] * (len(order) + 1)
    for k in range(len(order) - 1, -1, -1):
        sums, step = within[k + 1], order[k]
        most = min(counts[order[k]], room // step)
        taken = 1
        while taken <= most:
            n = min(taken, most - taken + 1)
            sums |= (sums << (step * n)) & full
            taken += n
        within[k] = sums
    kept: list[tuple[int, ...]] = []
    for waste in range(room + 1):
        if not within[0] >> (room - waste) & 1:
            continue
        stack = [(0, room - waste, ())]
        while stack:
            k, left, held = stack.pop()
            if not left:
                if any(dominates(g, held) for g in kept):
                    yield None
                else:
                    kept.append(held)
                    yield held
                continue
            while k < len(order) and order[k] > left:
                k += 1
            if k == len(order) or not within[k] >> left & 1:
                continue
            for n in range(min(counts[order[k]], left // order[k]) + 1):
                stack.append((k + 1, left - n * order[k], held + (order[k],) * n))


def dominates(wide: tuple[int, ...], narrow: tuple[int, ...]) -> bool:
    """Whether the pieces of narrow fit into places of the sizes of wide."""
    places = sorted(wide)
    for size in sorted(narrow, reverse=True):
        k = bisect_left(places, size)
        if k == len(places):
            return False
        insort(places, places.pop(k) - size)
    return True


@dataclass(frozen=True)
class Packing:
    """Patterns and how often each is used; the bound from below; what ended the search."""

    patterns: dict[Pattern, int]
    sequences: int
    bound: int
    ended: str


def summed(runs: list[tuple[Pattern, int]]) -> dict[Pattern, int]:
    out: Counter = Counter()
    for pattern, n in runs:
        out[pattern] += n
    return dict(out)


def search(counts: dict[int, int], capacity: int = CAPACITY, lengths: int = LENGTHS) -> Packing:
    """The packing with as few sequences as the search can reach.

    Branch and bound by bin completion: the largest length left is completed by each
    undominated filling in turn, a filling used as often as the counts allow or once; a
    branch is cut once its waste shows that it cannot beat the incumbent. The incumbent is
    the best-fit solution first, and the best-fit solution of what is left at each node.
    `ended` says "bound" if an incumbent met the lower bound, "searched" if nothing was left to
    try (both are optimal), and "budget" if the nodes have looked at `lengths` lengths and
    fillings: the packing is then no worse than best fit, and `bound` tells the gap.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return Packing({}, 0, 0, "bound")
    best = best_fit(counts, capacity)
    used, floor = sum(best.values()), lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    visited = 0

    def children(left: dict[int, int], done: list[tuple[Pattern, int]], bins: int, waste: int) -> Iterator[tuple]:
        nonlocal visited
        top = max(left)
        after = dict(left)
        after[top] -= 1
        if not after[top]:
            del after[top]
        for f in fillings(list(after), after, capacity - top):
            visited += 1 + len(f or ())
            if visited >= lengths:
                return
            if f is None:
                continue
            need = Counter((top, *f))
            most = min(left[s] // n for s, n in need.items())
            loss = capacity - top - sum(f)
            if waste + loss > (used - 1) * capacity - total:
                return  # fillings come by waste, so no later one can do
            for times in dict.fromkeys((most, 1)):
                if waste + loss * times <= (used - 1) * capacity - total:
                    then = {s: n - need.get(s, 0) * times for s, n in left.items()}
                    yield {s: n for s, n in then.items() if n}, [*done, (tuple(need.items()), times)], bins + times, waste + loss * times

    stack = [iter([(counts, [], 0, 0)])] if used > floor else []
    while stack and used > floor:
        if visited >= lengths:
            return Packing(best, used, floor, "budget")
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        left, done, bins, _ = node
        visited += len(left) + 20
        rest = best_fit(left, capacity)
        if bins + sum(rest.values()) < used:
            best, used = summed([*done, *rest.items()]), bins + sum(rest.values())
        if left and bins + lower_bound(left, capacity) < used:
            stack.append(children(*node))
    return Packing(best, used, floor, "bound" if used == floor else "searched")


def solve(counts: dict[int, int], capacity: int = CAPACITY, lengths: int = LENGTHS) -> dict[Pattern, int]:
    """Patterns and how often each is used: :func:`search` without its report."""
    return search(counts, capacity, lengths).patterns


def places(patterns: dict[Pattern, int]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: length, first rank, first sequence, pieces in a sequence, offset of the first."""
    rows, taken, sequence = [], Counter(), 0
    for pattern, n in sorted(patterns.items()):
        at = 0
        for size, k in pattern:
            rows.append((size, taken[size], sequence, k, at))
            taken[size] += n * k
            at += size * k
        sequence += n
    rows.sort()
    return {c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate(("length", "rank", "sequence", "each", "offset"))}


class WordIds:
    """Ids of whole texts under a vocabulary that folds case and drops white space.

    White space separates before anything is merged, so the ids of a text are those of its
    parts between blanks and line ends, which a memo keeps. A part of printable ASCII and Latin
    letters is folded and cut into pre-tokens by the tokenizer's own pattern, and takes its ids
    from their merges; any other part goes through the library as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merge = merged(self.library.model, self.library.get_vocab_size(with_added_tokens=True))
        self.parts = Memo(self.learn)

    def learn(self, part: str) -> bytes:
        core, mark = (part[:-1], part[-1]) if part[-1:] in (".", ",") else (part, "")
        if core.isalpha() and (core.isascii() or PLAIN.fullmatch(core)):
            return self.parts[core] + self.merge(mark) if mark else self.merge(core.lower())
        if PLAIN.fullmatch(part) and MARK not in part:
            return b"".join(map(self.merge, WORDS.findall(part.lower())))
        return np.array(self.library.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Parts are told apart for many texts at once, each text in segments of bounded size."""
        held: list[str] = []
        owners: list[int] = []
        size, last = 0, -1
        left: list[np.ndarray] = []
        for n, text in enumerate([*texts, None]):
            for segment in segments(text) if text is not None else [None]:
                if held and (segment is None or size + len(segment) > SEGMENT):
                    for k, found in zip(owners, self.of(held), strict=True):
                        if left and k != last:
                            yield np.concatenate(left)
                            left = []
                        left.append(found)
                        last = k
                    held, owners, size = [], [], 0
                if segment is not None:
                    held.append(folded(segment))
                    owners.append(n)
                    size += len(segment)
        if left:
            yield np.concatenate(left)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
        words = parts.flatten().dictionary_encode()
        known = list(map(self.parts.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        codes = words.indices.to_numpy()
        raw = b"".join(map(known.__getitem__, codes.tolist()))
        each = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = np.concatenate([[0], np.cumsum(each[codes])])[parts.offsets.to_numpy()].tolist()
        return [np.frombuffer(raw, "<u4", j - i, i * 4) for i, j in zip(at[:-1], at[1:], strict=True)]


def folded(text: str) -> str:
    """text with blanks for line ends and tabs, in lower case where that is safe ahead of the library."""
    if (text.isascii() or ODD.search(text) is None) and MARK not in text:
        text = text.lower()
    return text.replace("\n", " ").replace("\r", " ").replace("\t", " ")


def segments(text: str) -> Iterator[str]:
    """text in runs of about SEGMENT characters, cut before blanks alone."""
    at = 0
    while len(text) - at > SEGMENT and (cut := text.find(" ", at + SEGMENT)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


#: Characters that are taken apart at once.
SEGMENT = 1 << 21
#: The pattern of the tokenizer's pre-tokenizer (a fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: How the tokenizer's special tokens begin: they are matched before case is folded.
MARK = "<|"
#: Printable ASCII and Latin letters that fold to one letter each, all but the dotted I; and what may not be folded ahead.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*")
ODD = re.compile("[^\0-\u012f\u0131-\u024f\u2010-\u2027]")


_ENCODERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder a worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document: its ids and the separator, cut only if too long."""
    whole = np.append(ids, np.array([SEPARATOR], "<u4"))
    for piece, start in enumerate(range(0, len(whole), capacity)):
        part = whole[start : start + capacity]
        yield piece, start, len(part), zlib.crc32(part)


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every whole document. No shuffle."""

    def cut(batches):
        tool = word_ids(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [(doc, *p) for doc, ids in zip(part.column(0).to_pylist(), tool.ids(part.column(1).to_pylist()), strict=True) for p in pieces_of(ids, capacity)]
                kinds = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (any columns, with length from 1 to capacity) with sequence_id and offset, and of
    the whole packing n_sequences, least_sequences (the bound from below) and search_end.

    pieces has to give the same rows each time it is read, as a written table does. Two narrow
    shuffles: one for the counts, one by (length, group) for the ranks.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    packing = search(counts, capacity)
    found = places(packing.patterns)
    groups = max(1, -(-max(counts.values(), default=1) // RANKED))
    columns = pieces.columns
    others = [c for c in columns if c != "length"]
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64(*others), F.lit(groups)).cast("int"))
    sizes = grouped.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select(F.col("length").alias("_length"), F.col("_group").alias("_of"), before.alias("_base"))
    ranked = grouped.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy(*others)).cast("long") - 1)
    ranked = ranked.join(bases, (F.col("length") == F.col("_length")) & (F.col("_group") == F.col("_of")))
    ranked = ranked.select(*pieces.columns, (F.col("_rank") + F.col("_base")).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    wide = int(max(counts.values(), default=0)) + 1

    def deal(batches):
        key = found["length"] * wide + found["rank"]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length * wide + rank, "right") - 1
            nth, inner = np.divmod(rank - found["rank"][at], found["each"][at])
            cols = [*batch.columns[:-1], pa.array(found["sequence"][at] + nth), pa.array(found["offset"][at] + inner * length)]
            yield pa.RecordBatch.from_arrays(cols, [*columns, "sequence_id", "offset"])

    told = ranked.mapInArrow(deal, schema)
    return told.select("*", F.lit(packing.sequences).cast("long").alias("n_sequences"), F.lit(packing.bound).cast("long").alias("least_sequences"), F.lit(packing.ended).alias("search_end"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents, and how the search ended.

    A null text is empty and takes one token, the separator; a text of any length is cut only
    where a sequence ends. Repeated rows each get places of their own, and ties of length are
    dealt by the other columns; an empty table gives no rows; other columns of docs, whatever
    their names, are ignored.
    """
    return pack_pieces(written(tokenize(docs, tokenizer, capacity), "pieces"), capacity)
