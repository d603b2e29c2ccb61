"""Operators 1 and 7 against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from repolens.llm import common as C
from repolens.llm import decontam, minhash

from . import brute
from .conftest import words


def near_rows(n=40):
    """Chains of near copies, a group whose copies are alike only by way of
    the original, and documents that share half their words."""
    rng, out = random.Random(11), []
    for g in range(6):
        base = words(rng, 120)
        for k in range(n // 6):
            text = list(base)
            for _ in range(k if g % 2 else 3):
                text[rng.randrange(len(text))] = f"edit{rng.randrange(10 ** 6)}"
            out.append(" ".join(text))
        out.append(" ".join(base[:60] + words(rng, 60)))
    return [(10 * i + 3, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("size", [4, 5])
def test_components(frame, rows, size):
    pairs = rows + near_rows()
    out = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.clusters(frame(pairs), size).collect()]
    assert sorted(out, key=str) == sorted(brute.near_components(pairs, size), key=str)


def crowd(n=70):
    """Copies of one text with edits of their own, most of them alike to just
    below the threshold, so that a leader settles little."""
    rng, out = random.Random(3), []
    base = words(rng, 90)
    for k in range(n):
        text = list(base)
        for at in rng.sample(range(90), rng.choice([1, 2, 2, 3, 3, 4])):
            text[at] = f"edit{rng.randrange(10 ** 6)}"
        out.append((7 * k + 1, " ".join(text)))
    return out


def test_cells_find_what_leaders_leave(frame, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 9)
    monkeypatch.setattr(minhash, "LEADERS", 1)
    pairs = crowd()
    out = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.clusters(frame(pairs), 4).collect()]
    assert sorted(out) == sorted(brute.near_components(pairs, 4))


def test_a_cell_compares_a_pair_in_its_first_bucket():
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 1 << 62, 100, dtype=np.uint64))
    sets = [base, base[5:], np.sort(np.append(base[30:], rng.integers(0, 1 << 62, 30, dtype=np.uint64))), base[3:]]
    sig = [minhash.minima(x, np.array([0, len(x)]))[0] for x in sets]
    first = next(b for b in range(minhash.BANDS) if (sig[0].reshape(minhash.BANDS, -1)[b] == sig[1].reshape(minhash.BANDS, -1)[b]).all())

    def cell(band, own, lo, hi, label=(0, 1, 2, 0)):
        t = pa.table({"band": [band] * 4, "uid": range(4), "n": [len(x) for x in sets], "label": label, "own": own, "lo": [lo] * 4, "hi": [hi] * 4,
                      "sig": [x.astype("<u4").tobytes() for x in sig], "names": [np.unique(x.astype("<u4")).tobytes() for x in sets]})
        return sorted(zip(*minhash._in_cell(80)(t).to_pydict().values()))

    assert (0, 1) in cell(first, [0] * 4, 0, 0) and (0, 1) not in cell(minhash.BANDS, [0] * 4, 0, 0)
    assert not any(2 in p for p in cell(first, [0] * 4, 0, 0)) and (0, 3) not in cell(first, [0] * 4, 0, 0)  # too far; of one label
    assert (0, 1) in cell(first, [0, 1, 1, 0], 0, 1) and (0, 1) not in cell(first, [0, 0, 1, 1], 0, 1)


def test_short_names_lose_no_link():
    """Names that agree in 32 bits count for the pair."""
    x = np.arange(1, 11, dtype=np.uint64)
    twins = np.sort(np.append(x, x + (np.uint64(1) << np.uint64(32))))
    sig = np.zeros(minhash.BANDS * minhash.ROWS, "<u4").tobytes()
    short = next(minhash._short([pa.record_batch([pa.array([1, 2]), pa.array([twins.tobytes(), twins[:18].tobytes()], pa.binary()), pa.array([sig, sig])], names=["uid", "names", "sig"])]))
    assert [len(v) // 4 for v in short.column("names").to_pylist()] == [10, 10]
    cell = pa.table({"band": [0, 0], "uid": [1, 2], "n": [20, 18], "label": [1, 2], "own": [0, 0], "lo": [0, 0], "hi": [0, 0], "sig": [sig, sig], "names": short.column("names")})
    assert minhash._in_cell(80)(cell).to_pydict() == {"a": [1], "b": [2]}


def test_recall_at_the_threshold():
    """Sets of similarity 0.8 share a band and pass the signatures."""
    rng, met = np.random.default_rng(2), 0
    for _ in range(200):
        x = np.sort(rng.integers(0, 1 << 62, 90, dtype=np.uint64))
        y = np.sort(np.append(x[10:], rng.integers(0, 1 << 62, 10, dtype=np.uint64)))
        assert minhash._linked(x, [y], 80)[0]
        a, b = (minhash.minima(s, np.array([0, len(s)]))[0] for s in (x, y))
        met += (a == b).reshape(minhash.BANDS, -1).all(axis=1).any() and (a == b).mean() >= minhash.SIGNATURE_SHARE
    assert met >= 199


def test_repeated_rows_and_ids(frame, ragged):
    out = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.clusters(frame(ragged)).collect()]
    assert sorted(out, key=str) == sorted(brute.near_components(ragged, 5), key=str)


def test_representatives_keep_the_columns(frame, rows):
    df = frame(rows)
    out = minhash.representatives(df)
    assert out.schema == df.schema
    assert {r.doc_id for r in out.collect()} == {d for d, _, _, kept in brute.near_components(rows, 5) if kept}


def test_star_steps(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(edges, "a long, b long")
    out = {r.uid: r.label for r in minhash.components(df, C.Scratch(spark)).collect()}
    assert {x: out.get(x, x) for x in parent} == {x: root(x) for x in parent}


def test_empty_near(frame):
    assert minhash.clusters(frame([]).limit(0)).count() == 0
    assert minhash.clusters(frame([(1, None), (2, ""), (3, " ")])).filter("kept").count() == 3


def items(rows):
    rng = random.Random(23)
    long = [" ".join(words(rng, n)) for n in (12, 25, 40, 40, 3)]
    return long, [(i, t) for i, t in enumerate([*long, None, "", "...", rows[0][1][:200], long[1]])]


def planted(rows):
    long, _ = items(rows)
    out = list(rows)
    changed = long[2].split()
    changed[0], changed[-1] = "edited", "edited"
    broken = long[3].split()
    broken[10], broken[20], broken[30] = "x", "y", "z"
    out += [(5000, rows[1][1] + " " + long[0].upper() + "!! " + rows[2][1]), (5001, long[1]), (5002, rows[3][1] + "\n" + " ".join(changed)),
            (5003, " ".join(broken)), (5004, " ".join(long[1].split()[:23])), (5005, f"a {long[4]} b"), (5006, long[4]), (5007, long[0] + " " + long[0])]
    return out


def test_leaks(spark, frame, rows):
    docs, bench = planted(rows), items(rows)[1]
    table = spark.createDataFrame(bench, "item_id long, text string")
    out = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in decontam.contaminated(frame(docs), table).collect()}
    want = {(docs[d][0], bench[q][0]): v for (d, q), v in brute.leaks(docs, bench).items()}
    assert out == want
    assert {5000, 5001, 5002, 5004, 5005, 5006, 5007} <= {d for d, _ in out} and 5003 not in {d for d, _ in out}


@pytest.mark.parametrize("n", [40, 60, 100])
def test_rotated_item_is_a_leak(spark, frame, rows, n):
    item = [f"w{i}" for i in range(n)]
    turned = [*item[n // 2:], *item[:n // 2]]
    docs = [(1, " ".join([rows[0][1], *turned, rows[1][1]])), (2, " ".join(turned)), (3, " ".join([*item[:n // 2], rows[2][1], *item[n // 2:]]))]
    table = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    out = {r.doc_id: r for r in decontam.contaminated(frame(docs), table).collect()}
    want = {d: brute.best_window(t, " ".join(item)) for d, t in docs}
    assert set(out) == {d for d, (like, _) in want.items() if like >= 0.8} == {1, 2}
    assert all((out[d].similarity, out[d].start) == want[d] for d in out)
    assert [r.doc_id for r in decontam.clean(frame(docs), table).collect()] == [3]


def test_every_window_counts(spark, frame):
    """Random mixes of an item's parts, against all windows."""
    rng, docs = random.Random(31), []
    bench = [(q, [rng.choice("abcdefgh") * 2 + str(rng.randrange(30)) for _ in range(n)]) for q, n in enumerate((9, 15, 30, 30, 60))]
    for d in range(60):
        item = rng.choice(bench)[1]
        cut = sorted(rng.sample(range(len(item)), rng.randint(1, 2)))
        parts = [item[a:b] for a, b in zip([0, *cut], [*cut, len(item)])]
        rng.shuffle(parts)
        fill = lambda: [f"z{rng.randrange(99)}" for _ in range(rng.randint(0, 4))]
        docs.append((d, " ".join([*fill(), *[w for p in parts for w in p], *fill()])))
    table = spark.createDataFrame([(q, " ".join(t)) for q, t in bench], "item_id long, text string")
    out = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(frame(docs), table).collect()}
    want = {(d, q): brute.best_window(t, " ".join(i))[0] for d, t in docs for q, i in bench}
    assert out == {k: like for k, like in want.items() if like >= 0.8}
    assert len(out) > 10


def test_items_with_repeated_and_null_ids(spark, frame, rows):
    long, _ = items(rows)
    bench = [(None, long[0]), (None, long[1]), (4, long[2]), (4, long[3]), (4, long[3])]
    docs = [(1, " ".join([long[0], rows[0][1], long[1]])), (2, " ".join([long[2], rows[1][1], long[3]])), (3, rows[2][1])]
    table = spark.createDataFrame(bench, "item_id long, text string")
    out = [(r.doc_id, r.item_id, r.n_words) for r in decontam.contaminated(frame(docs), table).collect()]
    want = [(docs[d][0], bench[q][0], v[2]) for (d, q), v in brute.leaks(docs, bench).items()]
    assert sorted(out, key=str) == sorted(want, key=str) and len(out) == 5


def test_clean_documents_stay(spark, frame, rows):
    docs = planted(rows)
    table = spark.createDataFrame(items(rows)[1], "item_id long, text string")
    df = frame(docs)
    out = decontam.clean(df, table)
    bad = {docs[d][0] for d, _ in brute.leaks(docs, items(rows)[1])}
    assert out.schema == df.schema and {r.doc_id for r in out.collect()} == {d for d, _ in docs} - bad


def test_no_python_in_decontamination(spark, frame, rows):
    table = spark.createDataFrame(items(rows)[1], "item_id long, text string")
    plan = decontam.contaminated(frame(rows), table)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


def test_empty_benchmark(spark, frame, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(frame(rows), none).count() == 0
    assert decontam.clean(frame(rows), none).count() == len(rows)
    table = spark.createDataFrame(items(rows)[1], "item_id long, text string")
    assert decontam.contaminated(frame([]).limit(0), table).count() == 0
    ragged = [(1, rows[0][1]), (1, rows[0][1]), (None, rows[0][1]), (None, None)]
    assert decontam.contaminated(frame(ragged), table).count() == 3
