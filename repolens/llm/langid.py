"""Operator 6: language identification by hierarchical discrimination.

A text is first given a language family, then a language of that family; both
steps vote among one-versus-one linear support vector machines, each fitted
by dual coordinate descent.  Features are the hashed byte 1-, 2- and 3-grams of
the text (A-Z lower-cased) by share of positions.  The machines learn from a
bounded sample: ``SAMPLE`` documents of each language, those with the least
hash of the id.  More than ``LANGUAGES`` languages are an error: none is
dropped.

Training rows have a non-null lang and a crc32 of the doc_id's text modulo 3
that is not 1.

Defined results: a text that is null or has no letter is ``und`` with score 0;
without training rows all are ``und``; with one language, every text with a
letter has it with score 0.5; languages outside ``FAMILIES`` form the family
"other"; repeated rows are each predicted; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import svm
from .quality import held_out

SAMPLE = 1000
LANGUAGES = 200
FEATURES = 1 << 15
COST = 30.0
SCALE = 8.0
#: Families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy gd br",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr gu pa ur ne",
    "iranian": "fa ku ps",
    "semitic": "ar he mt",
    "greek": "el",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], "other")


def grams(data: np.ndarray, bounds: np.ndarray):
    """Feature of each 1-, 2- and 3-gram by its first byte (``FEATURES``
    where the document ends before it does): three arrays."""
    n = len(data)
    data = C._LOWER[data]
    stop = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    gram, out = np.zeros(n, np.uint32), []
    for k in range(3):
        gram[:n - k] = (gram[:n - k] << np.uint32(8)) + data[k:]
        name = (gram + np.uint32(k << 24)) * np.uint32(0x9E3779B1)
        out.append(np.where(stop > k, (name ^ (name >> np.uint32(15))) & np.uint32(FEATURES - 1), np.uint32(FEATURES)))
    return out


def has_letter(text) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _featured(batches):
    """mapInArrow function: (lang, text) -> (lang, at, share)."""
    for batch in batches:
        for a, b, data, bounds in C.slabs(batch.column("text")):
            f, at, share = grams(data, bounds), [], []
            for i in range(b - a):
                lo, hi = bounds[i], bounds[i + 1]
                counts = np.bincount(np.concatenate([x[lo:hi] for x in f]), minlength=FEATURES + 1)[:FEATURES]
                k = np.flatnonzero(counts)
                at.append(k.astype("<u4").tobytes())
                share.append((counts[k] / max(1, hi - lo)).astype("<f4").tobytes())
            yield pa.record_batch([batch.column("lang")[a:b], pa.array(at, pa.binary()), pa.array(share, pa.binary())], names=["lang", "at", "share"])


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Machines between families, and between the languages of each family:
    {"families": {family: [lang]}, "machines": [(one, other, weights, bias)]}."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    often = [r["lang"] for r in known.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(often) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang: raise LANGUAGES or clean the column")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # one row for each id of a language: at most SAMPLE * LANGUAGES are sent to every executor and reach the driver
    taken = known.select("doc_id", "lang").filter(F.col("lang").isin(often)).distinct().withColumn("r", rank).filter(F.col("r") <= sample).select("doc_id", "lang")
    rows = known.join(F.broadcast(taken), ["doc_id", "lang"], "left_semi").filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    got = rows.mapInArrow(_featured, "lang string, at binary, share binary").toPandas()
    got = got[got["lang"].isin(often)].sort_values(["lang", "at"], ignore_index=True)
    langs = sorted(set(got["lang"]))
    at = [np.frombuffer(x, "<u4").astype(np.int64) for x in got["at"]]
    value = [np.frombuffer(x, "<f4").astype(np.float64) * SCALE for x in got["share"]]
    groups: dict[str, list[str]] = {}
    for x in langs:
        groups.setdefault(family(x), []).append(x)
    kind = np.array([family(x) for x in got["lang"]], dtype=object)
    lang = got["lang"].to_numpy(dtype=object)

    def machine(of, one, other):
        rows = np.flatnonzero((of == one) | (of == other))
        y = np.where(of[rows] == one, 1.0, -1.0)
        cost = COST * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
        w, bias = svm.dual_coordinate_descent([at[i] for i in rows], [value[i] for i in rows], y, FEATURES, cost)
        return one, other, np.append(w * SCALE, 0).astype(np.float32), bias

    return {"families": groups, "between": [machine(kind, a, b) for a, b in combinations(sorted(groups), 2)],
            "within": {g: [machine(lang, a, b) for a, b in combinations(x, 2)] for g, x in groups.items()}}


def _vote(names: list[str], machines: list, margins: list[np.ndarray], n: int):
    """(winner index, its least margin) per document; ties go to the larger
    sum of margins, then to the earlier name."""
    wins, total, least = np.zeros((n, len(names))), np.zeros((n, len(names))), np.full((n, len(names)), np.inf)
    for (one, other, _, _), m in zip(machines, margins):
        for name, v in ((one, m), (other, -m)):
            k = names.index(name)
            wins[:, k] += v > 0
            total[:, k] += v
            least[:, k] = np.minimum(least[:, k], v)
    best = np.argmax(wins + 1e-3 * np.tanh(total / max(1, len(names))), axis=1)
    return best, least[np.arange(n), best]


def _predicted(model: dict):
    groups = model["families"]
    kinds = sorted(groups)

    def rows(batches):
        for batch in batches:
            text = batch.column("text").to_pylist()
            for a, b, data, bounds in C.slabs(batch.column("text")):
                n = b - a
                f = grams(data, bounds)
                size = np.maximum(1, np.diff(bounds))

                def margin(m, f=f, size=size, bounds=bounds):
                    _, _, w, bias = m
                    each = w[f[0]]
                    each += w[f[1]]
                    each += w[f[2]]
                    return np.diff(np.append(0, np.cumsum(each, dtype=np.float64))[bounds]) / size + bias

                lang, score = np.full(n, "und", dtype=object), np.zeros(n)
                if kinds:
                    kind, sure = _vote(kinds, model["between"], [margin(m) for m in model["between"]], n)
                    for k, g in enumerate(kinds):
                        of = np.flatnonzero(kind == k)
                        if len(of):
                            best, least = _vote(groups[g], model["within"][g], [margin(m)[of] for m in model["within"][g]], len(of))
                            lang[of] = np.array(groups[g], dtype=object)[best]
                            least = np.minimum(least, sure[of])
                            score[of] = np.where(np.isinf(least), 0.5, 1 / (1 + np.exp(-np.clip(2 * least, -30, 30))))
                for i in range(n):
                    if not has_letter(text[a + i]):
                        lang[i], score[i] = "und", 0.0
                yield pa.record_batch([batch.column("doc_id")[a:b], batch.column("held_out")[a:b], pa.array(lang, pa.string()), pa.array(score),
                                       batch.column("row")[a:b]], names=["doc_id", "held_out", "lang_pred", "score", "row"])

    return rows


def identify(docs: DataFrame, sample: int = SAMPLE, carry: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``; with
    ``carry`` also ``row``, a struct of all its columns."""
    model = train(docs, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (F.struct(*docs.columns) if carry else F.lit(None).cast("int")).alias("row")).withColumn("held_out", held_out())
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(_predicted(model), f"doc_id long, held_out boolean, lang_pred string, score double, row {kind}")
    return out if carry else out.drop("row")
