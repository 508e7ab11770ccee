"""Conversation repair, whitening and near-dedup of embeddings on small tables, against brute force."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from roadstats.llm import cap_filters, conversations, whitening
from roadstats.llm.queries import QUERIES
from tests.conftest import SF_SMALL

TURNS = "conv_id bigint, turn bigint, role string, text string, kind string, cost long, seg int"


# --- conversations -----------------------------------------------------------------------

def damage_by_hand(rows):
    """{conv_id: [(turn, role, text)]} after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        left = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        left.extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def repair_by_hand(rows):
    """The contract's values, the audit by a search over (row, role initials so far) in order of (cost, audit)."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else
                      "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best, heap = {}, [(0, "", 0, "", ())]
    while heap:
        cost, audit, at, state, repaired = heapq.heappop(heap)
        if (at, state) in best:
            continue
        best[at, state] = (cost, audit, repaired)
        for initial, role in (("u", "user"), ("a", "assistant")):
            if (state, initial) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", at, step[state, initial], (*repaired, f"{role}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, repaired))
            if faults[at] not in ("blank", "duplicate"):
                cut = faults[at] == "truncated"
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, step[state, role[:1]], (*repaired, f"{role}:{text}")))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if (state, initial) in step:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", at + 1, step[state, initial], (*repaired, f"{name}:{text}")))
    cost, audit, repaired = min(best[len(rows), s] for s in ("", "a") if (len(rows), s) in best)
    turns = [r[0] for r in rows if r[0] is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256("\n".join(repaired).encode()).hexdigest())


def got_repairs(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def some_conversations():
    r = random.Random(11)
    say = ["Hello.", "Why?", "no end", "", " \n\t", "Yes! ", "a.b", "é ", ".", None, "same."]
    rows = []
    for conv in range(300):
        for turn in range(r.choice([0, 1, 2, 3, 5, 8])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "sys", "ua"])
            rows.append((conv, r.choice([turn, turn, turn, turn * 3, None]), role, r.choice(say)))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (-5, None, None, None), (-5, None, None, None)]
    rows += [(7_000, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"word {t % 40}.") for t in range(700)]
    rows += [(8_000, 5, "user", "same turn."), (8_000, 5, "user", "same turn."), (8_000, 5, "assistant", "same turn.")]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def talks(spark):
    rows = [(*x, "kind", 1, 2) for x in some_conversations()]
    return spark.createDataFrame(rows, TURNS).repartition(5)


@pytest.mark.parametrize("ranges,held", [(1, 20_000), (7, 20_000), (200, 20_000), (3, 16)])
def test_repair_equals_search(spark, talks, ranges, held):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = got_repairs(conversations.repair(conversations.damaged(talks), held))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {c: repair_by_hand(rows) for c, rows in damage_by_hand(some_conversations()).items()}
    assert got == want


def test_repair_of_the_table(spark):
    table = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect()
    want = {c: repair_by_hand(v) for c, v in damage_by_hand([tuple(r) for r in table]).items()}
    assert got_repairs(QUERIES["op11_cyk_repair"](spark, SF_SMALL)) == want


def test_repaired_turns(spark, talks):
    rows = conversations.damaged(talks)
    turns = {}
    for r in conversations.repaired_turns(rows).collect():
        turns.setdefault(r["conv_id"], []).append((r["position"], f"{r['role']}:{r['text']}"))
    for conv, found in got_repairs(conversations.repair(rows)).items():
        said = sorted(turns.get(conv, []))
        assert [p for p, _ in said] == list(range(len(said)))
        assert hashlib.sha256("\n".join(t for _, t in said).encode()).hexdigest() == found[-1]


def test_cells_are_associative():
    r = random.Random(3)
    for _ in range(40):
        rows = [(r.choice(["s", "u", "a", ""]), r.random() < .3, r.random() < .3) for _ in range(r.randint(1, 30))]
        cut = r.randint(0, len(rows))
        whole = conversations.span_cell(rows)
        assert whole == conversations.combined(conversations.span_cell(rows[:cut]), conversations.span_cell(rows[cut:]))


def test_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversations.repair(conversations.damaged(none)).collect() == []
    assert conversations.repaired_turns(conversations.damaged(none)).collect() == []


# --- whitening ---------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, whitened string, at int, n int, cls int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, 2, 3) for i, v, lab in rows], VECTORS).repartition(6)


@pytest.mark.parametrize("make", [
    lambda r: r.standard_normal((400, 24)), lambda r: r.standard_normal((400, 24)) * np.logspace(0, -6, 24),
    lambda r: np.linalg.qr(r.standard_normal((90, 24)))[0] * np.repeat([3.0, 1.0], 12), lambda r: np.linalg.qr(r.standard_normal((90, 24)))[0],
    lambda r: r.standard_normal((9, 24)), lambda r: np.diag(np.abs(np.arange(-10, 11)) + 1.0) + np.diag(np.ones(20), 1),
    lambda r: np.hstack([r.standard_normal((50, 6))] * 3), lambda r: r.standard_normal((40, 1)), lambda r: r.standard_normal((40, 2))])
def test_bidiagonal_solver(make):
    r = whitening._triangle(make(np.random.default_rng(5)))
    a, b, v = whitening.bidiagonal(r)
    assert np.allclose(v.T @ v, np.eye(len(a)), atol=1e-13)
    values, found = whitening.bidiagonal_vectors(a, b)
    want = np.linalg.svd(r, compute_uv=False)
    assert np.abs(np.sqrt(values) - want).max() <= 1e-13 * want[0]
    held = want > 1e-12 * want[0]
    z = (v @ found)[:, held]
    assert np.abs(z.T @ z - np.eye(z.shape[1])).max() < 1e-9
    assert np.abs(r.T @ (r @ z) - z * values[held]).max() < 1e-12 * values[0]


def test_small_singular_values_are_accurate():
    a, b = np.logspace(0, -12, 20), np.logspace(0, -12, 20)[:-1] * 0.5
    got = np.sqrt(whitening.dqds((a * a).tolist(), (b * b).tolist()))
    # the product of the values of a bidiagonal is that of its diagonal
    assert abs(np.prod(got / 1e-6) / np.prod(a / 1e-6) - 1) < 1e-12


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((700, 40)) * np.linspace(1, 3, 40)).astype(np.float32)
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [], 1), (902, [float("nan")] * 40, 1), (903, [None] + [0.0] * 39, 1),
           (904, [float("inf")] + [0.0] * 39, 1), (905, [1.0] * 39, 1)]
    rows += [(None, x[0].tolist(), None), (5, x[5].tolist(), 2)]
    got = whitening.components(vectors_of(spark, rows + bad)).toPandas()
    assert len(got) == 702 * 32 and set(got.vec_id.dropna().unique()) <= set(range(700))
    c = np.floor(64 * np.array([v for _, v, _ in rows])).astype(np.int64) + 1_000_000
    n, s = len(c), c.sum(axis=0)
    off = c - s / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    want = off @ vectors / np.sqrt(values)
    for k in range(32):
        mine = got[(got.component == k + 1) & got.vec_id.notna() & (got.vec_id != 5)].sort_values("vec_id")
        w = np.delete(want[:700, k], 5)
        sign = np.sign(w @ mine.whitened.to_numpy())
        assert np.abs(mine.whitened.to_numpy() - sign * w).max() < 1e-8
        assert np.abs(mine.explained / (values[k] / (off ** 2).sum(axis=1).mean()) - 1).max() < 1e-10
        assert (mine.deviation.to_numpy() == np.delete(((n * c - s) ** 2).sum(axis=1)[:700], 5)).all()
    assert (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9


def test_whitening_of_little(spark):
    assert whitening.components(vectors_of(spark, [])).collect() == []
    assert whitening.components(vectors_of(spark, [(1, [1.0, 2.0], 1)])).collect() == []
    assert whitening.components(vectors_of(spark, [(i, [1.0, 2.0], 1) for i in range(9)])).collect() == []
    line = whitening.components(vectors_of(spark, [(i, [float(i), 2.0 * i], 1) for i in range(5)])).toPandas()
    assert len(line) == 5 and (line.component == 1).all() and abs(line.explained.iloc[0] - 1) < 1e-12


def test_deviation_is_exact_beyond_longs():
    model = whitening.Whitening(10 ** 8, (10 ** 17, 3), np.eye(2), np.ones(2), 1.0)
    x = np.array([[10 ** 9 + 7, 0], [2 * 10 ** 10, 5]])
    want = [sum((10 ** 8 * int(v) - s) ** 2 for v, s in zip(row, model.sums)) for row in x]
    assert whitening._deviation(x, model) == [w if w < 2 ** 63 else None for w in want]


# --- near-dedup --------------------------------------------------------------------------

def links_by_hand(rows):
    """{row number: (links, component)} by all cosines."""
    def fine(v, lab):
        return lab is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ok = [i for i, (_, v, lab) in enumerate(rows) if fine(v, lab)]
    near = {i: [] for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    near[i].append(j)
    out = {}
    for i in near:
        if i in out:
            continue
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        out |= {j: (len(near[j]), least) for j in reach}
    return out


def near_rows(n_hot, dimension=24):
    rng = np.random.default_rng(4)
    f32 = lambda v: np.asarray(v, np.float32).astype(float).tolist()
    rows, number = [], iter(range(10_000))
    for label in (1, 2):
        for _ in range(60):
            c = rng.standard_normal(dimension)
            rows.append((next(number), f32(c), label))
            for _ in range(rng.integers(0, 4)):
                z = rng.standard_normal(dimension)
                z *= rng.uniform(.05, .25) * np.linalg.norm(c) / np.linalg.norm(z)
                rows.append((next(number), f32((c + z) * rng.choice([1, 3])), label))
    hot = rng.standard_normal(dimension)
    rows += [(next(number), f32(hot + .09 * rng.standard_normal(dimension)), 1) for _ in range(n_hot)]
    rows += [(next(number), f32(hot), 1) for _ in range(30)] + [(next(number), f32(hot), 2), (next(number), f32(hot), None)]
    rows += [(9001, None, 1), (9002, [], 1), (9003, [0.0] * dimension, 1), (9004, [0.0] * dimension, 1), (9005, [None] * dimension, 1),
             (9006, [float("nan")] * dimension, 1), (9007, [float("inf")] * dimension, 1), (9008, f32(hot)[:5], 1), (9009, f32(hot)[:5], 1),
             (9010, [1e-30] * dimension, 2), (9011, [1e30] * dimension, 2), (9012, [2.0], 1), (9013, [3.0], 1), (9014, [-3.0], 1),
             (None, f32(hot), 1), (None, [7.0, 7.5], 1), (9015, [7.0, 7.5], 3), (9015, [7.0, 7.5], 3)]
    return rows


def test_near_duplicates_equal_all_cosines(spark, monkeypatch):
    rows = near_rows(200)
    want = links_by_hand(rows)
    known = sorted(((r[0], *want[i], r[0] is not None and r[0] == want[i][1]) for i, r in enumerate(rows)), key=str)
    for block in (1024, 20, 60):  # the last two: hot filters in many pairs of blocks, compared many at a time and one by one
        monkeypatch.setattr(cap_filters, "BLOCK", block)
        got = sorted(map(tuple, cap_filters.near_duplicates(vectors_of(spark, rows)).collect()), key=str)
        missed = sum(a[1] for a in known) - sum(b[1] for b in got)
        assert len(got) == len(known) and 0 <= missed <= 0.002 * sum(a[1] for a in known)
        assert [(g[0], g[2], g[3]) for g in got] == [(k[0], k[2], k[3]) for k in known]


@pytest.mark.parametrize("dimension", [2, 16, 64, 200])
def test_recall_at_the_threshold(dimension):
    rng = np.random.default_rng(dimension)
    x = cap_filters.unit_rows(rng.standard_normal((6000, dimension)))
    z = rng.standard_normal(x.shape)
    z = cap_filters.unit_rows(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * z
    shared = np.zeros(len(x), bool)
    for number in range(cap_filters.CODES):
        (i, f), (j, g) = cap_filters.caps(x, number), cap_filters.caps(y, number)
        size = cap_filters.WORDS ** cap_filters.BLOCKS
        shared[np.intersect1d(i * size + f, j * size + g) // size] = True
    assert shared.mean() >= 0.999


def test_caps_are_all_that_exceed():
    x = cap_filters.unit_rows(np.random.default_rng(8).standard_normal((5, 10)))
    rotation, directions = cap_filters.code(10, 0)
    parts = (x @ rotation).reshape(len(x), cap_filters.BLOCKS, -1)
    s = np.einsum("nbd,bkd->nbk", parts, directions)
    scores = s[:, 0, :, None, None, None] + s[:, 1, None, :, None, None] + s[:, 2, None, None, :, None] + s[:, 3, None, None, None, :]
    scores = scores.reshape(len(x), -1)
    i, f = np.nonzero(scores >= scores.max(axis=1, keepdims=True) - cap_filters.MARGIN)
    assert sorted(zip(i.tolist(), f.tolist())) == sorted(zip(*[a.tolist() for a in cap_filters.caps(x, 0)]))


def test_no_vectors(spark):
    assert cap_filters.near_duplicates(vectors_of(spark, [])).collect() == []
    got = cap_filters.near_duplicates(vectors_of(spark, [(3, None, None), (4, [1.0], 1)])).collect()
    assert sorted(map(tuple, got)) == [(3, 0, 3, True), (4, 0, 4, True)]
