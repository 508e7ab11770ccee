"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from a bounded sample of windows: with the base patterns'
spans, with made ones that no base pattern knows (spaced, bracketed and dotted forms, phones
without +), and with made numbers of other kinds.  Texts are cut into overlapping windows on a fixed grid; every window's tags
are decoded with the transitions, overlaps are settled by the window in which a
character is nearer the middle, and what the tags of the whole text say are the
network's spans.  Each kind holds a digit or an @; a tag run without one is no span, so
a window without one decodes to no tags at all and isn't run (``decode`` with
``every`` set runs them, to the same result).  A span of the network must pass its
kind's own test (``TESTS``: parts, digits, Luhn) and is added where it meets no base span.

Defined cases: a null text is an empty one, with no spans; equal texts give equal
spans; with nothing to learn from the network adds none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import give_back

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts only where a run of digits does, and gives none back: a long run is read once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")

WIDTH, STRIDE, HIDDEN = 96, 64, 12
_OWN = " \n.@+-()_%:/=\"',#*&$|!"
#: Classes of characters: other, a-z, A-Z, digits, beyond ASCII, then each of _OWN.
CLASSES = 5 + len(_OWN)
_CLASS = np.zeros(128, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
for _i, _x in enumerate(_OWN):
    _CLASS[ord(_x)] = 5 + _i


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def is_card(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def is_phone(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ so that long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = at - (len(before) - len(before.rstrip(LOCAL)))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            # a part of this run may be taken by the next address only after its own @
            done = at + 1
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if ANCHOR.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if is_ip(m[0])]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if is_card(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if is_phone(m[0])]
    return sorted(out)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], 4).astype(np.uint8)


def windows(n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Starts of the grid's windows over ``n`` characters; at: of those that hold one of these positions."""
    starts = np.arange(0, max(1, n - WIDTH + STRIDE), STRIDE) if n else np.empty(0, np.int64)
    if at is None:
        return starts
    held = np.zeros(len(starts), bool)
    for back in range(-(-WIDTH // STRIDE)):
        i = at // STRIDE - back
        i = i[(i >= 0) & (i < len(starts))]
        held[i] = True
    return starts[held]


class Network:
    """Two LSTMs, one each way, tag scores from both, and CRF transitions."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        k, h = len(KINDS) + 1, HIDDEN
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (CLASSES, 4 * h)).astype(np.float32)
            self.p["x" + d][:, h:2 * h] += 1  # the forget gate is open at first
            self.p["h" + d] = rng.normal(0, 0.3, (h, 4 * h)).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.3, (2 * h, k)).astype(np.float32)
        self.p["c"] = np.zeros(k, np.float32)
        self.p["t"] = (np.eye(k) * 2).astype(np.float32)

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """States (time, rows, hidden) of one direction; x: classes (rows, time), already turned for the way back."""
        n, steps, h = x.shape[0], x.shape[1], HIDDEN
        into, rec = self.p["x" + d], self.p["h" + d]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, held = np.empty((steps, n, h), np.float32), []
        for t in range(steps):
            z = into[x[:, t]] + state @ rec
            gates = np.tanh(z * _HALF) * 0.5 + 0.5  # sigmoid by tanh
            g = np.tanh(z[:, 3 * h:])
            i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:3 * h]
            before, cell = cell, f * cell + i * g
            tc = np.tanh(cell)
            if keep:
                held.append((state, before, i, f, o, g, tc))
            state = o * tc
            out[t] = state
        return out, held

    def scores(self, x: np.ndarray, keep: bool = False):
        """Tag scores (time, rows, tags)."""
        f, hf = self._lstm(x, "f", keep)
        b, hb = self._lstm(x[:, ::-1], "b", keep)
        both = np.concatenate([f, b[::-1]], axis=2)
        return both @ self.p["o"] + self.p["c"], (both, hf, hb)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (rows, time)."""
        e, _ = self.scores(x)
        best, back = e[0], []
        for t in range(1, len(e)):
            step = best[:, :, None] + self.p["t"]
            back.append(step.argmax(axis=1))
            best = step.max(axis=1) + e[t]
        tags = [best.argmax(axis=1)]
        for b in reversed(back):
            tags.append(b[np.arange(len(x)), tags[-1]])
        return np.array(tags[::-1]).T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of tags y (rows, time)."""
        e, (both, hf, hb) = self.scores(x, True)
        steps, n, k = e.shape
        trans, rows = self.p["t"], np.arange(n)

        def lse(a, axis):
            m = a.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        g = {"t": np.zeros_like(trans)}
        for t in range(steps):
            de[t, rows, y[:, t]] -= 1
            if t:
                g["t"] += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t] - z[:, None])[:, None, :]).sum(axis=0)
                np.subtract.at(g["t"], (y[:, t - 1], y[:, t]), 1)
        g["t"] /= n
        de /= n
        g["o"] = np.einsum("tnh,tnk->hk", both, de)
        g["c"] = de.sum(axis=(0, 1))
        dboth, ones = de @ self.p["o"].T, np.eye(CLASSES, dtype=np.float32)
        for d, held, ds in (("f", hf, dboth[:, :, :HIDDEN]), ("b", hb, dboth[::-1, :, HIDDEN:])):
            turned, h = x if d == "f" else x[:, ::-1], HIDDEN
            gx, gh = np.zeros_like(self.p["x" + d]), np.zeros_like(self.p["h" + d])
            dstate, dcell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t in range(steps - 1, -1, -1):
                state, before, i, f, o, gg, tc = held[t]
                dstate = dstate + ds[t]
                dcell = dcell + dstate * o * (1 - tc * tc)
                dz = np.concatenate([dcell * gg * i * (1 - i), dcell * before * f * (1 - f), dstate * tc * o * (1 - o),
                                     dcell * i * (1 - gg * gg)], axis=1)
                gx += ones[:, turned[:, t]] @ dz
                gh += state.T @ dz
                dstate, dcell = dz @ self.p["h" + d].T, dcell * f
            g["x" + d], g["h" + d] = gx, gh
        return g

    def learn(self, x: np.ndarray, y: np.ndarray, steps: int = 220, rows: int = 64, rate: float = 0.03, seed: int = 5):
        """Adam on batches of windows, three quarters of which hold a span."""
        rng, spanned = np.random.default_rng(seed), np.flatnonzero(y.any(axis=1))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, steps + 1):
            at = np.concatenate([rng.choice(spanned, rows * 3 // 4), rng.integers(0, len(x), rows // 4)])
            now = rate * (1 - 0.9 * step / steps)
            for k, g in self.gradients(x[at], y[at]).items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


_HALF = np.float32(0.5)


def _cut(c: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Windows (rows, WIDTH) of classes; beyond the text: line feeds."""
    padded = np.concatenate([c, np.full(WIDTH, _CLASS[10], np.uint8)])
    return padded[starts[:, None] + np.arange(WIDTH)]


def decode(network: Network, texts: list[str], every: bool = False, most: int = 1024) -> list[list[tuple[int, int, int]]]:
    """For each text the (start, kind, end) of the tags' runs that hold a digit or an @."""
    cuts, where = [], []
    coded = [classes(t) for t in texts]
    for i, c in enumerate(coded):
        anchors = np.flatnonzero((c == 3) | (c == _CLASS[64]))
        starts = windows(len(c), None if every else anchors)
        if len(anchors) and len(starts):
            cuts.append(_cut(c, starts))
            where += [(i, s) for s in starts.tolist()]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not where:
        return out
    x = np.concatenate(cuts)
    tags = np.concatenate([network.decode(x[a:a + most]) for a in range(0, len(x), most)])
    merged = {i: np.zeros(len(coded[i]), np.uint8) for i in {i for i, _ in where}}
    half = (WIDTH - STRIDE) // 2
    for (i, s), row in zip(where, tags):
        n = len(coded[i])
        # of two windows that overlap, the one in which a character is nearer the middle has the say
        a, b = (0 if s == 0 else half), (WIDTH if s + WIDTH >= n else WIDTH - half)
        merged[i][s + a:s + b] = row[a:b][:max(0, n - s - a)]
    for i, row in merged.items():
        edges = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
        held = np.r_[0, np.cumsum((coded[i] == 3) | (coded[i] == _CLASS[64]))]
        out[i] = [(int(a), int(row[a]) - 1, int(b)) for a, b in zip(edges[:-1], edges[1:]) if row[a] and held[b] > held[a]]
    return out


_GLUE = re.compile(r"[\x20\[\]()]")
_APART = re.compile(r"[\x20().\[\]/-]+")


def _is_email(s: str) -> bool:
    local, at, domain = s.partition("@")
    local = local.rstrip(" [(")
    return bool(at and local and not local.strip(LOCAL) and DOMAIN.fullmatch(_GLUE.sub("", domain)))


def _is_ip(s: str) -> bool:
    plain = _GLUE.sub("", s)
    return IP.fullmatch(plain) is not None and is_ip(plain)


def _is_card(s: str) -> bool:
    return not s.strip("0123456789 -./") and is_card(s)


def _is_phone(s: str) -> bool:
    groups = [g for g in _APART.split(s.lstrip("+")) if g]
    return is_phone(s) and all(g.isascii() and g.isdigit() for g in groups) and (
        s[0] == "+" or (3 <= len(groups) <= 5 and all(2 <= len(g) <= 4 for g in groups)))


#: What a span of the network must be, by kind.
TESTS = (_is_email, _is_ip, _is_card, _is_phone)


def all_spans(network: Network | None, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, as (start, kind, end)."""
    base = [base_spans(t) for t in texts]
    added = decode(network, texts) if network else [[] for _ in texts]
    out = []
    for text, own, more in zip(texts, base, added):
        extra = []
        for a, kind, b in more:
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            whole = not text[a - 1:a].isalnum() and not text[b:b + 1].isalnum()  # no part of a longer run
            if a < b and whole and TESTS[kind](text[a:b]) and not any(x < b and a < y for x, _, y in own):
                extra.append((a, kind, b))
        out.append((own, sorted(own + extra)))
    return out


def made_span(rng: np.random.Generator) -> tuple[str, int]:
    """(text, kind) of personal data as people write it, in a form that the base patterns don't find."""
    def word(a, b):
        return "".join(chr(c) for c in rng.integers(97, 123, rng.integers(a, b)))

    def pick(*forms):
        return forms[rng.integers(len(forms))]
    kind = int(rng.integers(4))
    if kind == 0:
        local = word(3, 8) + pick("", "." + word(3, 8), str(rng.integers(1, 99)))
        domain, end = word(3, 9), pick("com", "org", "net", "de", "co")
        return pick(f"{local} @ {domain}.{end}", f"{local}(@){domain}.{end}", f"{local}[@]{domain}.{end}",
                    f"{local} @ {domain} . {end}", f"{local}@{domain}[.]{end}"), kind
    if kind == 1:
        return pick(" . ", "[.]", "(.)").join(map(str, rng.integers(0, 256, 4))), kind
    if kind == 2:
        d = "".join(map(str, rng.integers(0, 10, 15)))
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick(".", "/", "  ", " - ").join(d[i:i + 4] for i in range(0, 16, 4)), kind
    a, b, c = rng.integers(200, 999), rng.integers(200, 999), rng.integers(1000, 9999)
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}) {b} {c}"), kind


def made_number(rng: np.random.Generator) -> str:
    """A number that is no personal data."""
    n = rng.integers(0, 10000, 6).tolist()
    forms = (f"{n[0]}", f"{n[0]}.{n[1] % 100:02d}", f"{1900 + n[0] % 200}-{1 + n[1] % 12:02d}-{1 + n[2] % 28:02d}",
             f"{n[0] % 24}:{n[1] % 60:02d}:{n[2] % 60:02d}", f"{n[0] % 20}.{n[1] % 20}.{n[2] % 20}", f"{n[0] % 999}-{n[1] % 999}",
             f"{n[0] % 9 + 1},{n[1] % 1000:03d},{n[2] % 1000:03d}", f"{n[0]}{n[1]}{n[2]}", f"{n[0] % 10}/{n[1] % 10}",
             f"{n[0] % 1000:03d}-{n[1]:04d}", f"({n[0] % 2100})", f"{n[0] % 99} {n[1] % 99} {n[2] % 99}", f"@ {n[0] % 100}")
    return forms[rng.integers(len(forms))]


def planted(text: str, rng: np.random.Generator, personal: bool) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags) of a window of ``text`` with a made span or number between two of its words."""
    put, kind = made_span(rng) if personal else (made_number(rng), -1)
    room = max(0, WIDTH - len(put) - 2)
    at = int(rng.integers(0, max(1, len(text) - room)))
    own = text[at:at + room]
    cuts = [i for i, c in enumerate(own) if c == " "] or [0]
    cut = cuts[rng.integers(len(cuts))]
    shown = f"{own[:cut]} {put}{own[cut:] or ' '}"
    tags = np.zeros(max(len(shown), WIDTH), np.uint8)
    for a, k, b in base_spans(shown):
        tags[a:b] = k + 1
    if personal:
        tags[cut + 1:cut + 1 + len(put)] = kind + 1
    return _cut(classes(shown), np.array([0]))[0], tags[:WIDTH]


def train(docs: DataFrame, sample: int = 2000, per_text: int = 6, per_text_made: int = 4) -> Network | None:
    """A network from the windows of at most ``sample`` texts that hold a digit or an @ (taken by a hash), at most
    ``per_text`` windows of each, and ``per_text_made`` with something planted: personal data and other numbers by turns."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").where(F.col("text").rlike("[0-9@]"))
    chosen = keyed.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(sample)
    texts = keyed.join(F.broadcast(chosen), "key", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, xs, ys = [], [], []
            for key, text in zip(pdf["key"], pdf["text"]):
                c, y = classes(text), np.zeros(len(text) + WIDTH, np.uint8)
                for a, kind, b in base_spans(text):
                    y[a:b] = kind + 1
                starts = windows(len(c), np.flatnonzero((c == 3) | (c == _CLASS[64])))
                # windows with spans first, then those with numbers that are none
                rank = np.argsort([not y[s:s + WIDTH].any() for s in starts], kind="stable")[:per_text]
                for s in starts[rank]:
                    keys.append(key)
                    xs.append(_cut(c, np.array([s]))[0].tobytes())
                    ys.append(y[s:s + WIDTH].tobytes())
                rng = np.random.default_rng(key % 2**63)
                for i in range(per_text_made):
                    c, tags = planted(text, rng, i % 2 == 0)
                    keys.append(key)
                    xs.append(c.tobytes())
                    ys.append(tags.tobytes())
            yield pd.DataFrame({"key": keys, "x": xs, "y": ys})
    got = texts.mapInPandas(run, "key bigint, x binary, y binary").dropDuplicates().toPandas()
    if not len(got) or not any(any(y) for y in got["y"]):
        return None
    got = got.sort_values(["key", "x", "y"])
    x = np.array([np.frombuffer(v, np.uint8) for v in got["x"]])
    y = np.array([np.frombuffer(v, np.uint8) for v in got["y"]]).astype(np.int64)
    return Network().learn(x, y, steps=500)


def detect(docs: DataFrame, network: Network | None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, ``base`` and ``spans``, arrays of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def named(spans):
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = [f for a in range(0, len(texts), 512) for f in all_spans(network, texts[a:a + 512])]
            yield pa.record_batch([batch.column(0), pa.array([named(b) for b, _ in found], kind),
                                   pa.array([named(s) for _, s in found], kind)], names=["doc_id", "base", "spans"])
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, base {spans}, spans {spans}")


def masked(network: Network | None, text: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; null stays null."""
    @F.pandas_udf("string")
    def mask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out, texts = [], [t or "" for t in part]
            for original, text, (_, spans) in zip(part, texts, (f for a in range(0, len(texts), 512) for f in all_spans(
                    network, texts[a:a + 512]))):
                pieces, at = [], 0
                for a, k, b in spans:
                    if b > at:
                        pieces += [text[at:max(a, at)], f"[{KINDS[k]}]"]
                        at = b
                out.append(None if original is None else "".join([*pieces, text[at:]]))
            yield pd.Series(out, dtype=object)
            del part, out, texts
            give_back()
    return mask(text)
