"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean query of trigrams that any match must
hold.  The index has one posting per document and trigram that some rule asks for;
postings are intersected per conjunction, and only documents that satisfy a rule's
query are searched for it.  A rule without mandatory trigrams is searched for in
every document.  The index folds case, so it may name too many documents, never too few.

Defined cases: a null text is an empty one, with no spans; equal rows are searched
alike, each on its own row; null doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as _c
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import save, sent


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group whose length counts, and the least length of it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds, in the order of ties (fixed values).
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # runs of 16 or more: the same as dropping the shorter of all runs
)
#: Formats of published key kinds, added to the base ones (fixed values).
ADDED = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{24,}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("login", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._!$-]{6,}@"),
)
RULES = BASE + ADDED

#: Strings that a part of a pattern is followed into at most.
MOST_STRINGS = 64


def _strings(tree) -> set[str] | None:
    """All (case-folded) strings that a pattern matches, if they are few; else None."""
    found = {""}
    for op, arg in tree:
        if op is _c.LITERAL:
            more = {chr(arg).lower()}
        elif op is _c.IN and all(o is _c.LITERAL for o, _ in arg):
            more = {chr(x).lower() for _, x in arg}
        elif op is _c.SUBPATTERN:
            more = _strings(arg[-1])
        elif op is _c.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] is not _c.MAXREPEAT and arg[1] <= 8:
            one = _strings(arg[2])
            more = one and {""}
            for i in range(arg[1] if one else 0):
                more = (more if i < arg[0] else more | {""}) if not i else more
                longer = {x + y for x in more for y in one}
                more = longer if i < arg[0] else more | longer
                if len(more) > MOST_STRINGS:
                    more = None
                    break
        else:
            more = None
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {x + y for x in found for y in more}
    return found


Query = frozenset  # of conjunctions, each a frozenset of trigrams; the empty conjunction holds everywhere
ALWAYS: Query = frozenset([frozenset()])


def _least(query) -> Query:
    return frozenset(x for x in query if not any(y < x for y in query))


def _both(a: Query, b: Query) -> Query:
    return _least({x | y for x in a for y in b})


def _of_strings(strings: set[str]) -> Query:
    return _least({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def trigram_query(pattern: str) -> Query:
    """What trigrams a match of ``pattern`` must hold: any of the conjunctions, all of its trigrams (case folded)."""
    def of(tree) -> Query:
        query, run = ALWAYS, {""}
        for item in tree:
            one = _strings([item])
            if one is not None and len(run) * len(one) <= MOST_STRINGS:
                run = {x + y for x in run for y in one}
                continue
            query, run = _both(query, _of_strings(run)), {""}
            op, arg = item
            if one is not None:
                run = one
            elif op is _c.SUBPATTERN:
                query = _both(query, of(arg[-1]))
            elif op is _c.BRANCH:
                query = _both(query, _least(frozenset().union(*[of(x) for x in arg[1]])))
            elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] > 0:
                query = _both(query, of(arg[2]))
        return _both(query, _of_strings(run))
    return of(_parser.parse(pattern))


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_key): which of ``trigrams`` each text holds, case folded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, keys = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                low = (text.as_py() or "").lower()
                here = [g for g in trigrams if g in low]
                grams += here
                keys += [key] * len(here)
            yield pa.record_batch([pa.array(grams, pa.string()), pa.array(keys, pa.int64())], names=["trigram", "doc_key"])
    return docs.select("doc_key", "text").mapInArrow(run, "trigram string, doc_key bigint")


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(doc_key, rules): the rules, as bits, whose query the document's postings satisfy."""
    rows = [(rule, i, t, len(conj)) for rule, q in queries.items() for i, conj in enumerate(sorted(q, key=sorted)) for t in conj]
    if not rows:
        return index.sparkSession.createDataFrame([], "doc_key bigint, rules bigint")
    wanted = index.sparkSession.createDataFrame(rows, "rule int, conj int, trigram string, need int")
    return index.join(F.broadcast(wanted), "trigram").groupBy("doc_key", "rule", "conj", "need").agg(
        F.count_distinct("trigram").alias("n")).where("n = need").groupBy("doc_key").agg(
        F.expr("bit_or(shiftleft(1L, rule))").alias("rules"))


def find(text: str, rules: tuple[Rule, ...], compiled: list[re.Pattern], on: int) -> list[tuple[int, int, int]]:
    """(start, rule, end) of the matches, leftmost and non-overlapping per rule, too short ones dropped."""
    out = []
    for i, rule in enumerate(rules):
        if on >> i & 1:
            out += [(m.start(), i, m.end()) for m in compiled[i].finditer(text)
                    if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return sorted(out)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and ``spans``, array of (kind, start, end) by start, then rule."""
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    whole = sum(1 << i for i, q in queries.items() if frozenset() in q)
    queries = {i: q for i, q in queries.items() if frozenset() not in q}
    trigrams = sorted({t for q in queries.values() for conj in q for t in conj})
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    found = save(candidates(build_index(keyed, trigrams), queries), "secret-candidates").withColumnRenamed("doc_key", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        for batch in batches:
            spans = [[{"kind": rules[i].kind, "start": a, "end": b} for a, i, b in
                      find(text.as_py() or "", rules, compiled, (on or 0) | whole)]
                     for text, on in zip(batch.column(1), batch.column(2).to_pylist())]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])
    kind = dict(docs.dtypes)["doc_id"]
    verified = keyed.join(sent(found, 24), F.col("doc_key") == F.col("key"), "left").select("doc_id", "text", "rules")
    return verified.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
