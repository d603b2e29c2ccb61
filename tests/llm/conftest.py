import random

import pytest

from repolens.llm import common as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, spans int"


def words(rng, n):
    syllables = "the an er ing ou th re on ti es ve la que der und ich de en".split()
    return [rng.choice(syllables) + rng.choice(syllables) + rng.choice(["", ",", "."]) for _ in range(n)]


def texts():
    """Small texts with every planted case: copies, near copies, a passage
    that many share, periodic and very long texts, odd white space, nulls."""
    rng = random.Random(7)
    base = [" ".join(words(rng, rng.randint(30, 160))) for _ in range(24)]
    passage = " ".join(words(rng, 70))
    out = list(base)
    out += [base[0], base[0], base[3]]                                   # exact copies
    near = base[5].split()
    for k in (4, 20, 40):
        near = near[:k] + ["changed"] + near[k + 1:]
        out.append(" ".join(near))
    out += [base[i][:80] + " " + passage + " " + base[i + 1][:90] for i in range(6, 12)]
    out += [passage, passage.upper(), "short text", "", None, "...", " \t\n ", "ab" * 300, "x " * 400, "línea única é\n" * 40]
    out += ["\n".join([base[13]] * 3), base[14] + "\n\n  " + base[14], "word " * 49, "ü" * 260]
    out.append(" ".join(words(rng, 6000)) + " " + passage)               # a very long text
    return out


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): ids out of order, with repeated rows and null ids."""
    made = [(1000 - 7 * i, t) for i, t in enumerate(texts())]
    return made


@pytest.fixture(scope="session")
def ragged(rows):
    """The same with repeated rows, repeated ids and null ids."""
    return [*rows[:12], *rows[24:40], rows[2], rows[2], (rows[3][0], "another text"), (None, rows[4][1]), (None, None)]


@pytest.fixture(scope="session")
def frame(spark):
    C.prepare(spark)

    def make(pairs, parts=3):
        data = [(d, t, ["en", "de", "fr", None][i % 4], [f"host{i % 3}", None][i % 5 == 0], len(t or ""), f"u{i}", i) for i, (d, t) in enumerate(pairs)]
        return spark.createDataFrame(data, SCHEMA).repartition(parts)

    return make
