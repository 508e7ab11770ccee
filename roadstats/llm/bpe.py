"""BPE encoding and decoding by prefix-sharing trie traversal.

Each batch's distinct new words go into a byte trie.  Its depth-first walk carries the
last token of the encoding of every prefix: of the tokens that end there, it is the
one that may follow the last token of the prefix it leaves, so a prefix that many
words share is worked out once.  A word's encoding follows the last tokens back.

Ids equal those of the tokenizers library for a byte-level BPE file whose merges are
ranked by id.  Defined cases: a null text is an empty one, with no ids; special tokens
in a text (added_tokens of the file) are encoded as themselves, as the library does;
equal rows give equal results, each on its own row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from roadstats.llm.common import give_back

#: The byte-level pre-tokenizer's pattern (fixed value).  \\s is spelt out as Unicode white space.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _S + r"\p{L}\p{N}]+|["
           + _S + r"]+(?![^" + _S + r"])|[" + _S + r"]+")
#: Words whose encodings a worker holds at once, unless told otherwise, and pairs of tokens known to follow or not.
HELD_WORDS, HELD_PAIRS = 600_000, 500_000


def byte_symbols() -> dict[str, int]:
    """{symbol: byte} of byte-level vocabularies: printable bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file: token bytes, merge ranks and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        own = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ids = {bytes(symbols[c] for c in t): i for t, i in own.items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(own[a], own[b]): (rank, own[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.follows: dict[tuple[int, int], bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def merged(self, word: bytes) -> list[int]:
        """The rule itself: again and again, join the pair of lowest rank, leftmost first."""
        parts = [self.ids[word[i:i + 1]] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.merges.get(p, (1 << 60, 0))[0], i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [self.merges[parts[at], parts[at + 1]][1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens: an encoding is one whose neighbours all do."""
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) > HELD_PAIRS:
                self.follows.clear()
            known = self.follows[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known


class Encoder:
    """Encodings of words, {word: (ids, decoded bytes)}, worked out over a trie of the words asked for together."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known, self.held = vocabulary, {}, HELD_WORDS
        #: What tokens end with: the token's id, or -1 for a mere end of a longer one.
        self.tails = {t[i:]: -1 for t in vocabulary.ids for i in range(1, len(t))} | vocabulary.ids

    def learn(self, words: set[str]) -> None:
        """Encode ``words``.  Their trie is held as the sorted words: that is its depth-first order, and what a word
        shares with the one before is the branch that both lie on."""
        vocabulary, tails, known = self.vocabulary, self.tails, self.known
        follows, may_follow, token_bytes = vocabulary.follows, vocabulary.may_follow, vocabulary.bytes
        last, size, before = [0], [0], b""  # last token of each prefix of the branch, and that token's length
        for path, word in sorted((w.encode(), w) for w in words):
            depth, most = 0, min(len(path), len(before))
            while depth < most and path[depth] == before[depth]:
                depth += 1
            del last[depth + 1:], size[depth + 1:]
            while depth < len(path):
                depth += 1
                ends, n = [], 1
                while n <= depth:
                    token = tails.get(path[depth - n:depth])
                    if token is None:
                        break
                    if token >= 0:
                        ends.append((token, n))
                    n += 1
                for token, n in reversed(ends):
                    if n == depth:
                        break
                    pair = (last[depth - n], token)
                    fits = follows.get(pair)
                    if may_follow(*pair) if fits is None else fits:
                        break
                last.append(token)
                size.append(n)
            found, at = [], depth
            while at:
                found.append(last[at])
                at -= size[at]
            found.reverse()
            known[word] = (",".join(map(str, found)), b"".join([token_bytes[t] for t in found]))
            before = path

    def pieces(self, text: str) -> list[str]:
        """The words of a text, special tokens among them."""
        if self.vocabulary.split_special is None or not any(x in text for x in self.vocabulary.special):
            return self.vocabulary.pattern.findall(text)
        out = []
        for part in self.vocabulary.split_special.split(text):
            if part in self.vocabulary.special:
                self.known[part] = (str(self.vocabulary.special[part]), part.encode())
                out.append(part)
            else:
                out += self.vocabulary.pattern.findall(part)
        return out

    def texts(self, texts: list[str]) -> list[tuple[list[str], list[bytes]]]:
        """For each text its words' ids (joined by commas) and decoded bytes."""
        words = [self.pieces(x) for x in texts]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > self.held:  # what these texts need stays together
            new = set().union(*words)
            special = {w for w in new if w in self.vocabulary.special}
            self.known = {w: (str(self.vocabulary.special[w]), w.encode()) for w in special}
            new -= special
        self.learn(new)
        known = self.known
        return [([known[w][0] for w in ws], [known[w][1] for w in ws]) for ws in words]


def in_chunks(texts: Iterable[str], most_chars: int = 1_000_000) -> Iterator[list[str]]:
    """Consecutive texts of about ``most_chars`` together; a longer text is a chunk of its own."""
    chunk, chars = [], 0
    for text in texts:
        if chunk and chars + len(text) > most_chars:
            yield chunk
            chunk, chars = [], 0
        chunk.append(text)
        chars += len(text)
    if chunk:
        yield chunk


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str, held: int) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    _ENCODERS[path].held = held
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, held: int = HELD_WORDS) -> DataFrame:
    """(doc_id, ids) of every row; ids: array of int.  ``path``: the vocabulary file, on every node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, held)
        for batch in batches:
            out = []
            for chunk in in_chunks(x.as_py() or "" for x in batch.column(1)):
                out += [[int(i) for piece in ids for i in piece.split(",")] for ids, _ in encoder.texts(chunk)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def digest(docs: DataFrame, path: str, held: int = HELD_WORDS) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256 (of the text
    that decoding the ids gives, bytes that aren't UTF-8 replaced).  ``held``: words whose encodings a worker holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, held)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for chunk in in_chunks(x.as_py() or "" for x in batch.column(1)):
                for ids, parts in encoder.texts(chunk):
                    joined = ",".join(ids)
                    counts.append(joined.count(",") + 1 if joined else 0)
                    ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded = b"".join(parts).decode("utf-8", "replace")
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                                   pa.array(text_sha, pa.string())],
                                  names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if held < HELD_WORDS:  # a worker that is to be small leaves nothing behind for later stages
            _ENCODERS.pop(path, None)
            del encoder
            give_back()
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
