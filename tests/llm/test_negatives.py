"""Operator 12 against all pairs, and the bounds that spare the scoring."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest

from repolens.llm import common as C
from repolens.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, q int, anchor string, score double, `a.b` int"


def plain(rows):
    """All rows (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score), as a sorted list."""
    kept = []
    for i, (ident, vector, label) in enumerate(rows):
        if ident is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((i, ident, int(math.fmod(label + 1, 10)) if ident % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = []
    for i, ident, label, q in kept:
        if ident % 100:
            continue
        score = {j: sum(a * b for a, b in zip(q, r)) for j, _, _, r in kept}
        order = sorted((x for x in kept if x[0] != i), key=lambda x: (-score[x[0]], x[1], x[0]))
        for j, positive, _, _ in [x for x in order if x[2] == label][:5]:
            inside = [x for x in order if x[2] != label and 30 * score[j] <= 100 * score[x[0]] <= 90 * score[j]]
            out += [(ident, positive, k + 1, x[1], score[j], score[x[0]]) for k, x in enumerate(inside[:10])]
    return sorted(out)


def table(spark, rows, parts=3):
    C.prepare(spark)
    return spark.createDataFrame([(*r, "u", i, "a", 0.5, i) for i, r in enumerate(rows)], SCHEMA).repartition(parts)


def vectors(n, dims, clusters, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    out = []
    for i in range(n):
        v = centres[i % clusters] + rng.normal(size=dims) * 0.4
        out.append((i * 10, (v / np.linalg.norm(v)).astype("f4").astype(float).tolist(), int(rng.integers(0, 4))))
    return out


def odd():
    out = vectors(160, 8, 3)
    same = out[20][1]
    out += [(5000 + i, same, i % 3) for i in range(60)]                       # one vector that many rows share
    out += [(100, same, 1), out[0], out[0], out[10], (300, out[30][1], None)]  # repeated rows and ids
    out += [(None, same, 1), (6000, None, 1), (6100, [], 1), (6200, [0.0] * 8, 2), (6300, [float("nan")] * 8, 1),
            (6400, [float("inf")] + [0.0] * 7, 1), (6500, [None] + [0.1] * 7, 1), (6600, [0.5, 0.5], 1), (-700, same, 2), (-7, same, -9), (6700, same, 99)]
    return out


@pytest.mark.parametrize("rows", [odd(), vectors(300, 16, 6), [(i * 100, [1.0, 0.0], i % 2) for i in range(30)], [(i * 100, [float(i % 3), -1.0], 0) for i in range(9)]])
def test_against_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(negatives, "ROWS", 50)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    got = sorted(tuple(r) for r in negatives.mine(table(spark, rows)).collect())
    assert got == plain(rows)


def test_empty_table(spark):
    assert negatives.mine(table(spark, odd()).limit(0)).count() == 0
    assert negatives.mine(table(spark, [(3, [1.0], 1)])).count() == 0


def side(x, references):
    stored = negatives._stored(references)
    batch = pa.record_batch([pa.array(range(len(x))), pa.array(range(len(x))), pa.array([0] * len(x)), pa.array([True] * len(x)), pa.array([v.tolist() for v in x])], names=["uid", "id", "label", "anchor", "q"])
    return negatives.Side(pa.Table.from_batches(list(stored([batch]))))


@pytest.mark.parametrize("scale", [3, 200, 10**6])
def test_bounds_hold_every_score(scale):
    rng = np.random.default_rng(scale)
    x = rng.integers(-scale, scale + 1, size=(120, 6))
    x[3] = x[2]
    x[5] = -x[2]
    x[7] = 0
    x[9] = x[2] * 2
    x[11] = x[2] + [1, 0, 0, 0, 0, 0]
    unit = x[[2, 20, 30]] / np.linalg.norm(x[[2, 20, 30]], axis=1)[:, None]
    for references in (unit, np.zeros((0, 0))):
        s = side(x, references)
        for a in range(40):
            at = np.arange(len(x))
            low, high = negatives.bounds(s, a, s, at)
            score = negatives.scores(s, a, s, at)
            assert score.tolist() == [int(sum(int(p) * int(q) for p, q in zip(x[a], row))) for row in x]
            assert (low <= score).all() and (score <= high).all()


def test_far_rows_are_not_scored(monkeypatch):
    """Among tight clusters the bounds rule nearly all other clusters out."""
    rng = np.random.default_rng(5)
    centres = np.eye(8) * 200
    x = np.vstack([np.round(c + rng.normal(size=(60, 8)) * 4) for c in centres]).astype(int)
    s = side(x, centres / 200)
    scored, real = [], negatives.scores
    monkeypatch.setattr(negatives, "scores", lambda *a: scored.append(len(a[3])) or real(*a))
    t = pa.table({"uid": s.uid, "id": s.id, "label": s.label, "norm": s.norm, "vector": pa.array([v.astype("<i8").tobytes() for v in x], pa.binary()), "angles": pa.array([a.astype("<f8").tobytes() for a in s.angles], pa.binary())})
    near = negatives._nearest(t, t)
    assert len(near) == 5 * len(x)
    assert sum(scored) < 0.2 * len(x) ** 2
    assert collections.Counter(near["anchor"].to_pylist()).most_common(1)[0][1] == 5


def test_scores_beyond_a_double_are_exact():
    x = np.array([[2**40 + 1, 1], [2**20 + 1, 3], [2**45, 7]])
    s = side(x, np.zeros((0, 0)))
    assert [int(v) for v in negatives.scores(s, 0, s, np.arange(3))] == [int(sum(int(p) * int(q) for p, q in zip(x[0], r))) for r in x]


def test_windows_are_exact_integers():
    for s in range(-5, 400):
        lo, hi = negatives.windows([s])[0]
        assert [n for n in range(-10, 400) if 30 * s <= 100 * n <= 90 * s] == list(range(lo, hi + 1))
