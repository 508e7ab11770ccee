"""URL filters: character language-model ratio.

Host and path rules judge what they fit.  Two variable-order Markov models, of the
URLs that the rules allow and of those they block, judge the rest: contexts of up to
three characters, each order smoothed by the next shorter one (Witten-Bell).  A URL is
blocked if its log-likelihood difference per character lies below a limit, calibrated
on the URLs of a fifth of the judged hosts, which the calibrated models haven't seen.

The labels are the rules' own, so the models don't see what a rule's host names: they
read the labels of a host before its last two (before a rule's host, if that is longer),
and what follows the host.  ``held_out`` tells how well that does on hosts left out.

Characters are folded to a fixed alphabet, so a model is a table of a fixed size
whatever the input; counts cover all URLs.  Defined cases: a null URL, or one without
``://``, has an empty host and path and fits no rule; the models read its whole text; an
empty text scores 0; without URLs of both verdicts everything that no rule fits is
allowed; equal rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import ascii_lower, save


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules (fixed values).
RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"),
         UrlRule("allow", "org", "/fr/"))

_SIGNS = "-./_?=&%#:"
#: Alphabet: 0 the start, 1 any other character, 2 a digit, then a-z and the signs.
ALPHABET = 3 + 26 + len(_SIGNS)
_FOLD = np.ones(256, np.int64)
_FOLD[48:58] = 2
_FOLD[97:123] = _FOLD[65:91] = np.arange(3, 29)
for _i, _x in enumerate(_SIGNS):
    _FOLD[ord(_x)] = 29 + _i
ORDER = 3
#: Bins of the calibration, per unit of score, and the greatest score told apart.
BINS, MOST = 100, 8


def codes(url: str | None) -> np.ndarray:
    """Each character with the three before it, as one number."""
    x = np.concatenate([np.zeros(ORDER, np.int64), _FOLD[np.frombuffer((url or "").encode(), np.uint8)]])
    out = x[:len(x) - ORDER].copy()
    for i in range(1, ORDER + 1):
        out = out * ALPHABET + x[i:len(x) - ORDER + i]
    return out


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(character | up to three before it) for every code, from the codes' counts."""
    n = counts.reshape((ALPHABET,) * (ORDER + 1)).astype(np.float64)
    p = np.full(ALPHABET, 1 / ALPHABET)
    for order in range(ORDER + 1):
        c = n.sum(axis=tuple(range(ORDER - order)))
        kinds = np.maximum((c > 0).sum(axis=-1, keepdims=True), 1)
        p = (c + kinds * p) / (c.sum(axis=-1, keepdims=True) + kinds)
    return np.log(p).ravel().astype(np.float32)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)"""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return ascii_lower(host), path


def read_by_models(url: Column, host: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The part of a URL that isn't the registered name: the host's labels before it, and all after the host."""
    labels = F.split(host, r"\.")
    named = F.greatest(F.lit(2), F.lit(0), *[F.when((host == r.host) | F.endswith(host, F.lit("." + r.host)),
                                                    r.host.count(".") + 1).otherwise(0) for r in rules])
    sub = F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - named, F.lit(0))), ".")
    at = F.instr(url, "://")
    after = F.concat(sub, F.substr(url, at + 3 + F.length(host)))
    return F.when(F.coalesce(at, F.lit(0)) > 0, after).otherwise(F.coalesce(url, F.lit("")))


def ruled(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, read, rule, decided): what the models read, the longest rule that fits, and its verdict;
    the last two may be null."""
    host, path = split_url(F.col("url"))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    df = df.withColumn("read", read_by_models(F.col("url"), F.col("host"), rules)).drop("url")
    rule = decided = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        rule = F.when(fits, r.name) if rule is None else rule.when(fits, r.name)
        decided = F.when(fits, r.verdict) if decided is None else decided.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return df.select("*", (none if rule is None else rule).alias("rule"), (none if rule is None else decided).alias("decided"))


def _code_counts(judged: DataFrame) -> DataFrame:
    """(slot, code, n) over all URLs that a rule judged, slot: 2 for blocked, and 1 for the fold; each task adds up its
    own first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for slot, part in pdf.groupby("slot"):
                code, n = np.unique(np.concatenate([codes(u) for u in part["read"]]), return_counts=True)
                yield pd.DataFrame({"slot": slot, "code": code, "n": n})
    slot = F.when(F.col("decided") == "block", 2).otherwise(0) + F.col("fold").cast("int")
    rows = judged.where("decided is not null").select(slot.cast("tinyint").alias("slot"), "read")
    return rows.mapInPandas(run, "slot tinyint, code int, n bigint").groupBy("slot", "code").agg(F.sum("n").alias("n"))


def score(table: np.ndarray, url: Column) -> Column:
    """Log-likelihood difference per character; 0 for an empty text."""
    @F.pandas_udf("double")
    def scored(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in urls:
            yield pd.Series([float(table[c].mean(dtype=np.float64)) if len(c := codes(u)) else 0.0 for u in part])
    return scored(url)


def fit(judged: DataFrame) -> tuple[np.ndarray, float] | None:
    """(log-likelihood differences by code, limit) from rows (host, read, decided); None without both verdicts."""
    folded = judged.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(5)) == 0)
    # at most four slots of ALPHABET ** 4 codes, 13 bytes each
    got = save(_code_counts(folded), "url-counts").toArrow()
    slot, code, n = (got.column(c).to_numpy() for c in ("slot", "code", "n"))
    counts = [np.bincount(code[slot == i], n[slot == i], ALPHABET ** (ORDER + 1)) for i in range(4)]
    allow, block = counts[0] + counts[1], counts[2] + counts[3]
    if not (allow.any() and block.any()):
        return None
    tried = log_probabilities(counts[0]) - log_probabilities(counts[2])
    bins = folded.where("decided is not null and fold").select("decided", F.floor(
        F.greatest(F.least(score(tried, F.col("read")), F.lit(float(MOST))), F.lit(-float(MOST))) * BINS).alias("bin"))
    limit = _limit({(r["decided"], r["bin"]): r["n"] for r in bins.groupBy("decided", "bin").agg(
        F.count("*").alias("n")).collect()})
    return log_probabilities(allow) - log_probabilities(block), limit


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict and score (null where a rule decides)."""
    judged = ruled(pages, rules)
    model = fit(judged)
    if model is None:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("decided", F.lit("allow")).alias("verdict"),
                             F.lit(None).cast("double").alias("score"))
    out = judged.withColumn("score", F.when(F.col("decided").isNull(), score(model[0], F.col("read"))))
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(
        F.col("score") < model[1], "block").otherwise("allow")).alias("verdict"), "score")


def held_out(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame | None:
    """(decided, verdict, n): a rule's verdict against that of models fitted without the hosts counted here (a sixth)."""
    judged = ruled(pages, rules).where("decided is not null")
    left_out = F.pmod(F.xxhash64(F.lit("held out"), "host"), F.lit(6)) == 0
    model = fit(judged.where(~left_out))
    if model is None:
        return None
    verdict = F.when(score(model[0], F.col("read")) < model[1], "block").otherwise("allow")
    return judged.where(left_out).groupBy("decided", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def _limit(hist: dict[tuple[str, int], int]) -> float:
    """The score that best parts the verdicts: the greatest (blocked share of block) - (blocked share of allow), in the
    middle of the gap up to the next score."""
    total = {v: sum(n for (w, _), n in hist.items() if w == v) for v in ("allow", "block")}
    if not all(total.values()):
        return 0.0
    best, limit, below = 0.0, -float(MOST), {"allow": 0, "block": 0}
    bins = sorted({b for _, b in hist})
    for b, after in zip(bins, [*bins[1:], bins[-1] + 1]):
        for v in below:
            below[v] += hist.get((v, b), 0)
        gain = below["block"] / total["block"] - below["allow"] / total["allow"]
        if gain > best:
            best, limit = gain, (b + 1 + after) / 2 / BINS
    return limit
