"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over code points cuts every text into chunks; where passages are shared, so
are the chunks, and a worker encodes each once. A cut may fall inside a word, so chunks are
not encoded alike at their edges. At each join the words are matched anew from a boundary
that is certain on the left until a match starts where one of the right chunk's own matches
starts: from there on both are the same, as the pattern never looks back. Merges never cross
a match, so equal matches are equal ids.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import text_of
from spanloom.llm.memo import Memo, byte_letters, merged

#: The pattern of the tokenizer's pre-tokenizer (a fixed value), and the same for plain ASCII.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS = regex.compile(PATTERN)
ASCII_WORDS = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+""", re.ASCII)
#: Code points that a match may look at beyond its own end.
AHEAD = 3
#: Rolling hash: window, one cut in MASK + 1 places, least code points of a chunk; matches kept of a chunk's head.
HASHED, MASK, LEAST, HEAD = 16, 1023, 128, 32
STEP = np.uint32(0x9E3779B1)
CHUNK_MEMO = 20_000


def matches(text: str) -> list[str]:
    """The pre-tokens of text. Control characters 28-31 are white space to one library only."""
    if text.isascii() and not re.search(r"[\x1c-\x1f]", text):
        return ASCII_WORDS.findall(text)
    return WORDS.findall(text)


def cuts(text: str) -> list[int]:
    """Where chunks begin: places that depend on the HASHED code points before them alone."""
    n = len(text)
    if n < 2 * LEAST:
        return [0]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) * STEP
    width, power = 1, np.uint32(0x85EBCA6B)
    with np.errstate(over="ignore"):
        while width < HASHED:
            codes = codes[width:] + codes[:-width] * power
            power, width = power * power, width * 2
    codes ^= codes >> np.uint32(15)
    found, last = [0], 0
    for at in (np.flatnonzero((codes & np.uint32(MASK)) == 0) + HASHED).tolist():
        if at - last >= LEAST and n - at >= LEAST:
            found.append(at)
            last = at
    return found


class Encoder:
    """Ids of whole texts, exactly as the library gives them, and texts of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.words = Memo(merged(self.library.model, size), 250_000)
        self.chunks: dict[str, tuple] = {}
        plain = {c: b for b, c in byte_letters().items()}
        names = [self.library.id_to_token(i) or "" for i in range(size)]
        marks = set(self.special.values())
        self.bytes = [n.encode() if i in marks else bytes(plain[c] for c in n) for i, n in enumerate(names)]
        self.digits = [b"%d," % i for i in range(size)]

    def chunk(self, text: str) -> tuple:
        """(ids, places of its first matches, certain end): a place is code points -> ids before it."""
        if (known := self.chunks.get(text)) is None:
            found = matches(text)
            head, at, before = {}, 0, 0
            ids = self.words.join(found)
            for m in found[:HEAD]:
                head[at] = before
                at, before = at + len(m), before + len(self.words[m])
            end, tail, k = len(text), len(ids), len(found)
            while k and end > len(text) - AHEAD:
                k -= 1
                end, tail = end - len(found[k]), tail - len(self.words[found[k]])
            if len(self.chunks) >= CHUNK_MEMO:
                self.chunks.clear()
            known = self.chunks[text] = (ids, head, end, tail)
        return known

    def section(self, text: str) -> bytes:
        """Ids of a text without marks, as 32-bit numbers."""
        starts = cuts(text)
        if len(starts) == 1:
            return self.words.join(matches(text)) if len(text) < 2 * LEAST else self.chunk(text)[0]
        out = []
        at, skip = 0, 0  # a certain boundary within the chunk, and the ids before it
        ends = [*starts[1:], len(text)]
        k, words = 0, WORDS
        while k < len(starts):
            begin = starts[k]
            ids, _, end, tail = self.chunk(text[begin : ends[k]])
            if k == len(starts) - 1:
                out.append(ids[skip:])
                break
            if end > at:
                out.append(ids[skip:tail])
                at = end
            again, joined = [], None
            for m in words.finditer(text, begin + at):
                s = m.start()
                while k + 1 < len(starts) and s >= ends[k]:
                    head = self.chunk(text[starts[k + 1] : ends[k + 1]])[1]
                    if s - starts[k + 1] in head:
                        joined = s - starts[k + 1]
                        break
                    if s >= ends[k + 1]:
                        k += 1
                        continue
                    break
                if joined is not None:
                    break
                again.append(m.group())
            out.append(self.words.join(again))
            if joined is None:
                break
            k += 1
            at, skip = joined, self.chunk(text[starts[k] : ends[k]])[1][joined]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.marks is None or not (found := list(self.marks.finditer(text))):
            return np.frombuffer(self.section(text), "<u4").tolist()
        out, at = [], 0
        for m in found:
            out += np.frombuffer(self.section(text[at : m.start()]), "<u4").tolist() if m.start() > at else []
            out.append(self.special[m.group()])
            at = m.end()
        return out + (np.frombuffer(self.section(text[at:]), "<u4").tolist() if at < len(text) else [])

    def decode(self, ids: list[int]) -> bytes:
        """The text in UTF-8; bytes that make no character become the replacement character."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()

    def decimal(self, ids: list[int]) -> bytes:
        return b"".join(map(self.digits.__getitem__, ids))[:-1]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_column(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every whole text; null texts are empty. No shuffle."""

    def encoded(batches):
        tool = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tool.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(encoded, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode every whole text, decode its ids.

    A null text is empty and has no ids. A text of any length is encoded whole, its chunks one
    after another. Repeated rows give repeated rows; an empty table gives none; other columns,
    whatever their names, are ignored. A map over rows: nothing is shuffled. Chunks are reused
    within a worker, which keeps the last CHUNK_MEMO at most.
    """

    def both(batches):
        tool = encoder(tokenizer)
        for batch in batches:
            n, ids_of, texts_of = [], [], []
            for text in batch.column(1):
                ids = tool.encode(text.as_py())
                n.append(len(ids))
                ids_of.append(hashlib.sha256(tool.decimal(ids)).hexdigest())
                texts_of.append(hashlib.sha256(tool.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_of, pa.string()), pa.array(texts_of, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(both, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
