"""A bounded memo for the pieces of text that a Python worker meets again and again."""

from __future__ import annotations

from collections.abc import Callable

#: Characters of a piece that a memo keeps.
LONGEST = 128


class Memo(dict):
    """str -> bytes for pieces of at most LONGEST characters, in two halves of at most `most` entries.

    A full half becomes the old one and gives back what is asked for again, so frequent pieces
    stay. Longer pieces are worked out each time: the memo's size is bounded in bytes, and
    results never depend on what it holds.
    """

    def __init__(self, fill: Callable[[str], bytes], most: int = 150_000):
        super().__init__()
        self.fill, self.most = fill, most
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST:
            return self.fill(piece)
        value = self.old.get(piece)
        if value is None:
            value = self.fill(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value

    def join(self, pieces: list[str]) -> bytes:
        """The values of all pieces, one after another."""
        return b"".join(map(self.__getitem__, pieces))


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies show each byte: printable ones stand for themselves."""
    shown = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = (b for b in range(256) if b not in shown)
    return shown | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = str.maketrans(byte_letters())


def merged(model, size: int) -> Callable[[str], bytes]:
    """Ids (below size), as little-endian 32-bit numbers, of a single pre-token, by the library's merges alone."""
    packed = [i.to_bytes(4, "little") for i in range(size)]

    def fill(word: str) -> bytes:
        if not (word.isascii() and word.isalnum()):
            word = word.encode().decode("latin-1").translate(LETTERS)
        return b"".join([packed[t.id] for t in model.tokenize(word)])

    return fill
