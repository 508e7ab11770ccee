"""The words of many texts at once, as arrays: where they stand, their hashes and their shingles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

from roadstats.llm.shingles import SHINGLE

#: Bytes of a word up to which it is hashed with the others, and words hashed together.
LONG, TOGETHER = 512, 50_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_COEFFICIENTS = np.random.default_rng(17).integers(1, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Words:
    """Of ``texts`` (null: empty), per word in order: ``text`` (which one), ``line`` (counted over all texts), ``first``
    and ``last`` (bytes of all texts, end exclusive) and ``hash`` (64 bits, A-Z lower-cased)."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        #: First byte of each text, and one more.
        self.at = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.data = np.frombuffer(b"\n".join(raw).lower() + b"\n", np.uint8)
        space = _SPACE[self.data]
        self.first = np.flatnonzero(~space & np.r_[True, space[:-1]])
        self.last = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        self.text = np.searchsorted(self.at, self.first, "right") - 1
        self.turns = np.flatnonzero(self.data == 10)
        self.line = np.searchsorted(self.turns, self.first)
        self._tails = np.flatnonzero((self.data & 0xC0) == 0x80)  # bytes that begin no code point
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        sizes = self.last - self.first
        out = np.zeros(len(sizes), np.uint64)
        short = np.flatnonzero(sizes <= LONG)
        for a in range(0, len(short), TOGETHER):
            own = short[a:a + TOGETHER]
            n = sizes[own]
            offset = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(offset, n)
            value = (self.data[np.repeat(self.first[own], n) + place].astype(np.uint64) + np.uint64(1)) * _COEFFICIENTS[place]
            out[own] = np.add.reduceat(value, offset)
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.first[i]:self.last[i]].tobytes())
        return mixed(out + sizes.astype(np.uint64))

    def points(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Code points before byte ``at`` in its text."""
        begin = self.at[text]
        return at - np.searchsorted(self._tails, at) - (begin - np.searchsorted(self._tails, begin))

    def first_line(self, text: np.ndarray) -> np.ndarray:
        """The line in which a text begins."""
        return np.searchsorted(self.turns, self.at[text])

    def line_bytes(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of a line and the byte of its end."""
        return np.where(line > 0, self.turns[np.maximum(line, 1) - 1] + 1, 0), self.turns[line]

    def shingles(self) -> np.ndarray:
        """Hashes of the five words from each word on (int64); those that run over the end of a text are no shingles."""
        n = max(0, len(self.hash) - SHINGLE + 1)
        out = mixed(self.hash[:n] + np.uint64(SHINGLE))
        for i in range(1, SHINGLE):
            out = mixed(out + self.hash[i:i + n])
        return out.view(np.int64)

    def runs(self, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, words) of each run of words with one value of ``by``."""
        head = np.flatnonzero(np.r_[True, by[1:] != by[:-1]]) if len(by) else np.empty(0, np.int64)
        return head, np.diff(np.r_[head, len(by)])


def taken(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, offsets): ``n`` places from each ``first`` on, one after the other, and where each run begins."""
    offset = np.cumsum(n) - n
    return np.repeat(first - offset, n) + np.arange(n.sum()), offset


def in_chunks(texts: Iterable, most_bytes: int = 1_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts): consecutive Arrow strings of about ``most_bytes`` together; a longer one is alone."""
    begin, chunk, held = 0, [], 0
    for i, text in enumerate(texts):
        text = text.as_py()
        if chunk and held + len(text or "") > most_bytes:
            yield begin, chunk
            begin, chunk, held = i, [], 0
        chunk.append(text)
        held += len(text or "")
    if chunk:
        yield begin, chunk
