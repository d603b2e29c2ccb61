"""Operator 7: near-duplicate documents by MinHash.

A document's set is its distinct ``size``-word shingles (words lower-cased in
A-Z; with fewer words, the whole sequence as one).  ``BANDS * ROWS`` universal
hash minima make its signature.  Documents with equal sets are one class, and
only its first document goes on.  Band keys put classes into buckets; a
bucket's members are compared with its leader, the one that has most company
over all its buckets (an original rather than one of its edited copies), links
are verified by signature and then on the full sets, and connected components
come from alternating large-star and small-star.  Buckets that still hold
several components take a next leader, ``LEADERS`` in all.

What is open after that is compared inside cells: a bucket is dealt into
blocks of ``BLOCK_ROWS`` members, a cell holds two of them with signatures and
sets, and only links leave it, never the pairs.  A pair that shares
several buckets is compared in the first of them alone.  A large bucket so
becomes many small tasks, and any link in any bucket is found.  Cells hold
names of 32 bits, which can only add links; whole sets decide on those.

Two documents of similarity 0.8 share no band with probability
(1 - 0.8 ** ROWS) ** BANDS = 5e-5; their signatures fall short of
``SIGNATURE_SHARE`` with less than that.

Defined results: documents without words or text have an empty set, link with
nothing and stay; repeated rows and null ids are numbered in order
(``common.keyed``), so only the first of equal rows stays; an empty table gives
an empty result; other columns are ignored (``representatives`` carries them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 25, 5
#: Rounds of comparing buckets with one leader each.
LEADERS = 2
#: Least share of equal minima that the full comparison is made for.
SIGNATURE_SHARE = 0.62
_SEED = 20260101
#: Shingles hashed at once in the inner loop.
BLOCK = 1 << 13

#: Members of a bucket that a block holds.
BLOCK_ROWS = 256

_RNG = np.random.default_rng(_SEED)
_MUL = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int):
    """Distinct shingle names of documents laid end to end: (names sorted by
    document, bounds of the documents in them)."""
    word, _, _, doc = C.words_flat(data, bounds, lower=True)
    n_docs = len(bounds) - 1
    if not len(word):
        return word, np.zeros(n_docs + 1, np.int64)
    count = np.bincount(doc, minlength=n_docs)
    ends = np.cumsum(count)
    name = word.copy()
    room = ends[doc] - np.arange(len(word))  # words from here to the document's end
    for k in range(1, size):
        nxt = np.zeros_like(word)
        nxt[:-k] = word[k:]
        name = np.where(room > k, C.pair_name(name, nxt), name)
    # full shingles, and the first position of documents with fewer words
    use = (room >= size) | ((count[doc] < size) & (room == count[doc]))
    name = C.pair_name(name, np.minimum(room, size).astype(np.uint64))[use]
    doc = doc[use]
    order = np.lexsort((name, doc))
    name, doc = name[order], doc[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    return name[new], np.searchsorted(doc[new], np.arange(n_docs + 1))


def minima(names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signatures (one row per non-empty set): upper halves of the minima of
    a * x + b modulo 2 ** 64, for each (a, b)."""
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    out = np.full((len(full), len(_MUL)), np.iinfo(np.uint64).max, np.uint64)
    if not len(full):
        return out.astype(np.uint32)
    owner = np.repeat(np.arange(len(full)), size[full])
    for lo in range(0, len(names), BLOCK):
        x, of = names[lo:lo + BLOCK], owner[lo:lo + BLOCK]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        who = of[first]
        for i in range(len(_MUL)):
            out[who, i] = np.minimum(out[who, i], np.minimum.reduceat(x * _MUL[i] + _ADD[i], first))
    return (out >> np.uint64(32)).astype(np.uint32)


def _signed(size: int):
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary())])

    def rows(batches):
        for batch in batches:
            for a, b, data, bounds in C.slabs(batch.column("text")):
                names, sb = shingle_sets(data, bounds, size)
                n = np.diff(sb)
                full = np.flatnonzero(n)
                s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(full):
                    s1[full] = np.add.reduceat(C.mix(names * np.uint64(0x9E3779B97F4A7C15)), sb[:-1][full])
                    s2[full] = np.add.reduceat(C.mix(names + np.uint64(0x632BE59BD9B4E019)), sb[:-1][full])
                sig: list = [None] * len(n)
                for i, row in zip(full.tolist(), minima(names, sb)):
                    sig[i] = row.astype("<u4").tobytes()
                yield pa.record_batch([batch.column("uid")[a:b], batch.column("doc_id")[a:b], pa.array(n.astype(np.int64)), C.as_long(s1),
                                       C.as_long(s2), pa.array(sig, pa.binary())], schema=schema)

    return rows


def _bands(batches):
    """mapInArrow function: (uid, n, sig) -> (uid, n, band key, band), BANDS rows each."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, BANDS, ROWS).astype(np.uint64)
        band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2])
        key = band.copy()
        for r in range(ROWS):
            key = C.pair_name(key, sig[:, :, r])
        uid, n = (pa.array(np.repeat(batch.column(c).to_numpy(), BANDS)) for c in ("uid", "n"))
        yield pa.record_batch([uid, n, C.as_long(key.reshape(-1)), pa.array(band.reshape(-1).astype(np.int32))], names=["uid", "n", "key", "band"])


def _by_signature(batches):
    """mapInArrow function: (a, b, sig_a, sig_b) -> (a, b) that may be alike."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, BANDS * ROWS) for c in ("sig_a", "sig_b"))
        like = pa.array((x == y).mean(axis=1) >= SIGNATURE_SHARE) if len(x) else pa.array([], pa.bool_())
        yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(like)


def _sets(size: int):
    """mapInArrow function: (uid, text) -> (uid, names): the sorted set."""
    def rows(batches):
        for batch in batches:
            for a, b, data, bounds in C.slabs(batch.column("text")):
                names, sb = shingle_sets(data, bounds, size)
                out = [names[sb[i]:sb[i + 1]].astype("<u8").tobytes() for i in range(b - a)]
                yield pa.record_batch([batch.column("uid")[a:b], pa.array(out, pa.binary())], names=["uid", "names"])

    return rows


def shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many names of the sorted set ``one`` each other set has."""
    size = np.array([len(x) for x in others])
    names = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, names), len(one) - 1)] == names
    return np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)


def _linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    both = shared(one, others)
    return 100 * both >= percent * (len(one) + np.array([len(x) for x in others]) - both)


def _by_sets(percent: int):
    """mapInArrow function: (a, b, names_a, names_b) -> linked (a, b)."""
    def rows(batches):
        for batch in batches:
            xs, ys = (batch.column(c).to_pylist() for c in ("names_a", "names_b"))
            keep = [bool(_linked(np.frombuffer(x, "<u8"), [np.frombuffer(y, "<u8")], percent)[0]) for x, y in zip(xs, ys)]
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def _short(batches):
    """mapInArrow function: (..., names) with names cut to 32 bits, sorted."""
    for batch in batches:
        names = [np.unique(np.frombuffer(x, "<u8").astype("<u4")).tobytes() for x in batch.column("names").to_pylist()]
        at = batch.schema.get_field_index("names")
        yield batch.set_column(at, "names", pa.array(names, pa.binary()))


def _in_cell(percent: int):
    """applyInArrow function: the members of two blocks of a bucket -> pairs
    (a, b) between the blocks, or inside the block if both are one, that are
    links by names of 32 bits.  A set's names that fall together there count
    for the pair, so no link is missing; the whole names decide later."""
    def links(cell: pa.Table) -> pa.Table:
        uid, n, label, own = (cell.column(c).to_numpy() for c in ("uid", "n", "label", "own"))
        band, lo, hi = (cell.column(c)[0].as_py() for c in ("band", "lo", "hi"))
        sig = np.frombuffer(b"".join(cell.column("sig").to_pylist()), "<u4").reshape(len(uid), BANDS, ROWS)
        names = [np.frombuffer(x, "<u4") for x in cell.column("names").to_pylist()]
        less = n - np.array([len(x) for x in names])
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            same, before = np.zeros((len(left), len(right)), np.int16), np.zeros((len(left), len(right)), bool)
            for b in range(BANDS):
                whole = np.ones_like(before)
                for r in range(ROWS):
                    equal = sig[left, b, r][:, None] == sig[right, b, r][None, :]
                    same += equal
                    whole &= equal
                if b < band:
                    before |= whole
            x, y = n[left][:, None], n[right][None, :]
            # a pair is compared in its first bucket, once, and only if its sizes and signatures allow a link
            open_ = ~before & (label[left][:, None] != label[right][None, :]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (same >= SIGNATURE_SHARE * BANDS * ROWS)
            if lo == hi:
                open_ &= uid[left][:, None] < uid[right][None, :]
            for i in np.flatnonzero(open_.any(axis=1)):
                js = right[np.flatnonzero(open_[i])]
                a, k = uid[left[i]], left[i]
                both = shared(names[k], [names[j] for j in js]) + np.minimum(less[k], less[js])
                found += [(int(min(a, uid[j])), int(max(a, uid[j]))) for j in js[100 * both >= percent * (n[k] + n[js] - both)]]
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return links


def components(edges: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(uid, label): the least uid reachable, for every uid in ``edges``
    (a, b).  Alternates large-star (neighbours above u go to the least
    neighbour) and small-star (neighbours below u, and u, go to the least)
    until the edges stay the same."""
    def state(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    cur = scratch.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    seen = state(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.put(both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        nxt = scratch.put(small)
        now = state(nxt)
        scratch.drop(cur, large)
        cur = nxt
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("uid"), F.col("v").alias("label"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(uid, doc_id, n_shingles, component_uid) per row of ``common.keyed``
    documents; a component is named by its least uid."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    signed = scratch.put(docs.select("uid", "doc_id", "text").mapInArrow(_signed(size), "uid long, doc_id long, n long, s1 long, s2 long, sig binary"))
    classes = scratch.put(signed.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("uid").alias("rep")))
    reps = scratch.put(signed.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi").select("uid", "n", "sig"))
    # a document takes its class's component
    member = scratch.put(signed.join(classes, ["n", "s1", "s2"], "left").select("uid", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "uid").alias("rep")))
    scratch.drop(signed, classes)
    keys = scratch.put(reps.mapInArrow(_bands, "uid long, n long, key long, band int"))
    crowded = scratch.put(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    # a member's weight: how much company it has over all its buckets
    weight = keys.join(crowded, "key").groupBy("uid").agg(F.sum("c").alias("w"))
    buckets = scratch.put(keys.join(crowded.select("key"), "key").join(weight, "uid"))
    scratch.drop(keys, crowded)
    # signatures and sets of those with company: texts are read once more and shuffled once;
    # sort-merge joins at every size, so that the plan does not change with the input
    company = buckets.select("uid").distinct().hint("merge")
    sets = scratch.put(docs.select("uid", "text").join(company, "uid", "left_semi").mapInArrow(_sets(size), "uid long, names binary").join(reps.select("uid", "sig"), "uid"))
    scratch.drop(reps)

    of = lambda side, what: sets.select(F.col("uid").alias(side), F.col(what).alias(f"{what}_{side}")).hint("merge")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked by their whole sets."""
        both = pairs.join(of("b", "names"), "b").join(of("a", "names"), "a").select("a", "b", "names_a", "names_b")
        return scratch.put(both.mapInArrow(_by_sets(percent), "a long, b long"))

    def links(pairs: DataFrame) -> DataFrame:
        """The linked pairs, those first that are by their signatures."""
        likely = scratch.put(pairs.join(of("a", "sig"), "a").join(of("b", "sig"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_by_signature, "a long, b long"))
        linked = verified(likely)
        scratch.drop(likely)
        return linked

    # sets of which one is below percent % of the other's size cannot be linked
    sized = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    open_ = buckets.withColumn("label", F.col("uid"))
    found = led = None
    for _ in range(LEADERS):
        free = open_ if led is None else open_.join(led, ["key", "uid"], "left_anti")
        heads = free.groupBy("key").agg(F.max(F.struct("w", (-F.col("uid")).alias("u"), "n", "label")).alias("h"))
        heads = scratch.put(heads.select("key", (-F.col("h.u")).alias("a"), F.col("h.n").alias("na"), F.col("h.label").alias("la")))
        new = scratch.put(open_.select("key", F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb")).join(heads, "key")
                          .filter((F.col("la") != F.col("lb")) & sized).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        led = heads.select("key", F.col("a").alias("uid"))
        linked = links(new)
        scratch.drop(new)
        found = linked if found is None else scratch.put(found.unionByName(linked))
        label = scratch.put(components(found, scratch))
        named = scratch.put(buckets.join(label, "uid", "left").withColumn("label", F.coalesce("label", "uid")))
        mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).filter("lo != hi").select("key", "m")
        before, open_ = open_, scratch.put(named.join(mixed, "key"))
        scratch.drop(named, label, before)
        if open_.isEmpty():
            break
    blocks = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
    dealt = open_.select("uid", "n", "key", "band", "label", F.pmod(F.xxhash64("uid"), blocks).cast("int").alias("own"), blocks.alias("blocks"))
    short = scratch.put(sets.join(open_.select("uid").distinct(), "uid", "left_semi").mapInArrow(_short, "uid long, names binary, sig binary"))
    cells = (dealt.join(short.hint("merge"), "uid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", "band", "uid", "n", "label", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "sig", "names"))
    close = scratch.put(cells.groupBy("key", "lo", "hi").applyInArrow(_in_cell(percent), "a long, b long"))
    rest = verified(close)
    label = scratch.put(components(found.unionByName(rest), scratch))
    scratch.drop(buckets, sets, open_, short, close, found, rest)
    named = label.select(F.col("uid").alias("rep"), "label")
    return member.join(named, "rep", "left").select("uid", "doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_uid"))


def clusters(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; component_id is the
    doc_id of the component's first document, which alone is kept."""
    found = C.Scratch(docs.sparkSession).put(near_duplicates(C.keyed(docs), size, percent))
    names = found.select(F.col("uid").alias("component_uid"), F.col("doc_id").alias("component_id"))
    return found.join(names, "component_uid").select("doc_id", "n_shingles", "component_id", (F.col("uid") == F.col("component_uid")).alias("kept"))


def representatives(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component."""
    rows = C.keyed(docs, whole=True)
    kept = near_duplicates(rows, size, percent).filter("uid = component_uid").select("uid")
    return rows.join(kept, "uid", "left_semi").select("row.*")
