"""Operator 1: benchmark decontamination, in DataFrame functions.

Words are the lower-cased text's runs between white space, without
punctuation; shingles are 5 consecutive words (a shorter item is one shingle).
A document's windows have the word count of an item.  Similarity does not
heed the order of shingles, so a window counts wherever its shingles stand in
the item: those are taken that cover as many places with a shingle of an item
of their size as the threshold needs (see ``_starts``).  Windows and items
get 64-bit SimHash fingerprints.
``RADIUS + 1`` blocks of the fingerprint index the items of a size: two
fingerprints within ``RADIUS`` agree on one block at least, so all items
within the radius are candidates.  For these the weighted similarity of the
shingles (a shingle weighs its count: sum of minima over sum of maxima) is
computed exactly, and ``threshold`` or more is a leak.

A task holds pieces of ``PIECE`` words, never the words of a whole document,
and the places of a block of ``PIECE`` words (or an item's, if longer), never
all of a document.  Documents without enough shingles of an item are left
out by their key before texts are joined, so no other text is shuffled.  Items of the
same shingles are compared once.

At similarity 0.8 fingerprints differ in about 9 +- 3 bits.

Defined results: null or empty texts and items match nothing; a document
shorter than the item is one window; repeated documents or items each match,
one row for each row of the benchmark (ids may be repeated or null); of several windows of a document that match
an item, the most similar counts, then one in which a shingle stands at the
same place as in an item, then the first; empty tables give an empty result; other columns are ignored (``clean`` carries them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 20
BITS = 64
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&@^~`_+=/\\-"
#: Benchmark shingles are sent to all executors up to so many rows (32 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Words of a piece of a long text.
PIECE = 16_384


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _plain(text: str) -> Column:
    return F.translate(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), PUNCTUATION, "")


def _split(plain: Column) -> Column:
    return F.filter(F.split(plain, C.SEPARATOR_CLASS + "+"), lambda w: w != "")


def _pieces(plain: Column, size: int, more: int) -> Column:
    """The text cut after every ``size`` words; each piece also holds the next
    ``more`` words.  A text too short for more than ``size`` words is one piece."""
    word = f"[^{C.SEPARATOR_CLASS[1:-1]}]++{C.SEPARATOR_CLASS}*+"
    cut = f"(?=((?:{word}){{1,{size + more}}}+))(?:{word}){{1,{size}}}+"
    return F.when(F.length(plain) < 2 * size, F.array(plain)).otherwise(F.regexp_extract_all(plain, F.lit(cut), F.lit(1)))


def _grams(words: Column, size: int) -> Column:
    """Hashes of ``size`` consecutive words, by place; empty if there are fewer."""
    return F.when(F.size(words) < size, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])))


def _grams_for(words: Column, item_words: Column) -> Column:
    """Grams of the size that an item of so many words is compared by."""
    out = _grams(words, SHINGLE)
    for k in range(1, SHINGLE):
        out = F.when(item_words == k, _grams(words, k)).otherwise(out)
    return out


def _fingerprint(grams: Column) -> Column:
    """SimHash: bit b is that of most grams."""
    def bit(b: int) -> Column:
        ones = F.aggregate(grams, F.lit(0), lambda n, g: n + F.shiftright(g, b).bitwiseAND(1).cast("int"))
        return F.when(2 * ones > F.size(grams), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    out = bit(0)
    for b in range(1, BITS):
        out = out.bitwiseOR(bit(b))
    return out


def _blocks(fingerprint: Column) -> Column:
    """(block, value) for each block of the fingerprint."""
    cuts = [BITS * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftright(fingerprint, lo).bitwiseAND((1 << (hi - lo)) - 1).alias("value"))
                     for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])


def _similarity(x: Column, y: Column) -> Column:
    """Sum of minima over sum of maxima of the shingles' counts."""
    count = lambda a, g: F.size(F.filter(a, lambda v: v == g))
    both = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, g: n + F.least(count(x, g), count(y, g)))
    return _let(both, lambda n: n / (F.size(x) + F.size(y) - n))


def _starts(hits: Column, need: Column, seen: Column, first: Column) -> Column:
    """Starts of the windows of ``seen`` shingles with ``need`` or more of
    ``hits`` (ascending places) that end in a hit at ``first`` or later, or stand at 0.  The first of
    the windows most similar to an item is among them: if its last shingle
    were none of the item's, the window one word before would be as similar."""
    last = F.filter(F.sequence(need - 1, F.size(hits) - 1), lambda b: (F.get(hits, b) >= first) & (F.get(hits, b) - F.get(hits, b - need + 1) < seen))
    return F.transform(last, lambda b: F.greatest(F.lit(0), F.get(hits, b) - seen + 1))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(uid, doc_id, item_id, similarity, start, n_words) for ``common.keyed``
    documents: window start .. start+n_words-1 (in words) repeats the item."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    items = benchmark.select(F.col("item_id"), _split(_plain("text")).alias("words")).filter("size(words) > 0")
    items = items.withColumn("n", F.size("words"))
    # a key of its own for each row: ids may be repeated or null
    rows = scratch.put(items.select(F.monotonically_increasing_id().alias("row"), "item_id", "n", _grams_for(F.col("words"), F.col("n")).alias("grams")))
    items = scratch.put(rows.groupBy("n", "grams").agg(F.min("row").alias("item")).withColumn("fp", _fingerprint(F.col("grams"))))
    names = rows.join(items.select("n", "grams", "item"), ["n", "grams"]).select("item", "item_id")
    sums = items.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("grams")).alias("grams"), F.max("n").alias("longest")).first()
    small = lambda df, n: F.broadcast(df) if (n or 0) <= BROADCAST_ROWS else df
    # where in items of which size a shingle stands
    spots = scratch.put(items.select("n", F.posexplode("grams").alias("j", "gram")).distinct())
    short = [r["n"] for r in spots.filter(F.col("n") < SHINGLE).select("n").distinct().collect()]  # below SHINGLE rows
    n_spots = spots.limit(BROADCAST_ROWS + 1).count()
    # shingles of the item and of the window, and how many they share at the threshold
    less = F.least(F.col("n"), F.lit(SHINGLE)) - 1
    own, seen = F.col("n") - less, F.least(F.col("n"), F.col("size")) - less
    need = F.greatest(F.lit(1), F.ceil(threshold * (own + seen) / (1 + threshold) - 1e-9).cast("int"))
    pieces = docs.select("uid", _plain("text").alias("plain")).select("uid", _pieces(F.col("plain"), PIECE, SHINGLE - 1).alias("pieces"))
    before = F.size("pieces") - 1
    tail = F.when(before > 0, before * PIECE + F.size(_split(F.get("pieces", before))))  # words of a text of several pieces
    pieces = pieces.select("uid", tail.alias("tail"), F.posexplode("pieces").alias("piece", "plain"))
    words = pieces.select("uid", "tail", "piece", _split(F.col("plain")).alias("words"))
    seeds = []
    for k in [SHINGLE, *short]:
        at = spots.filter(F.col("n") >= SHINGLE if k == SHINGLE else F.col("n") == k)
        part = F.col("words") if k == SHINGLE else F.slice("words", 1, PIECE + k - 1)
        grams = words.select("uid", F.coalesce("tail", F.size("words")).alias("size"), "piece", F.posexplode(_grams(part, k)).alias("i", "gram"))
        found = grams.join(small(at, n_spots), "gram").withColumn("i", F.col("piece") * PIECE + F.col("i"))
        room = F.greatest(F.col("size") - F.col("n"), F.lit(0))
        seeds.append(found.select("uid", "n", "size", seen.alias("seen"), need.alias("need"), "i",
                                  F.greatest(F.lit(0), F.least(F.col("i") - F.col("j"), room)).alias("start")))
    hits = seeds[0]
    for s in seeds[1:]:
        hits = hits.unionByName(s)
    # a block has the windows that end in it, with the hits of these, which may stand before it
    block = F.greatest(F.lit(PIECE), F.col("n"))
    at = lambda place: F.floor(place / block).cast("int")
    none = F.lit(None).cast("int")
    own_hit = F.struct(at(F.col("i")).alias("block"), F.col("i").alias("i"), none.alias("start"))
    next_hit = F.struct((at(F.col("i")) + 1).alias("block"), F.col("i").alias("i"), none.alias("start"))
    window = F.struct(at(F.col("start") + F.col("seen") - 1).alias("block"), none.alias("i"), F.col("start").alias("start"))
    entries = F.when(F.col("i") % block >= block - F.col("seen"), F.array(own_hit, next_hit, window)).otherwise(F.array(own_hit, window))
    hits = hits.select("uid", "n", "seen", "need", F.explode(entries).alias("e"))
    hits = hits.groupBy("uid", "n", "e.block").agg(F.max("seen").alias("seen"), F.max("need").alias("need"),
                                                   F.sort_array(F.collect_set("e.i")).alias("hits"), F.collect_set("e.start").alias("placed"))
    hits = hits.filter("size(hits) >= need")
    place = lambda placed: lambda s: F.struct(s.alias("start"), F.lit(placed).alias("placed"))
    others = F.array_except(_starts(F.col("hits"), F.col("need"), F.col("seen"), F.col("block") * block), F.col("placed"))
    starts = hits.select("uid", "n", F.explode(F.concat(F.transform("placed", place(True)), F.transform(others, place(False)))).alias("p"))
    starts = scratch.put(starts.select("uid", "n", "p.start", "p.placed"))
    # windows are cut from pieces that hold all words of those that begin in them
    longest = sums["longest"] or 1
    wide = max(PIECE, longest)
    by_piece = starts.groupBy("uid", F.floor(F.col("start") / wide).cast("int").alias("piece")).agg(F.collect_list(F.struct("n", "start", "placed")).alias("places"))
    held = starts.select("uid").distinct()
    texts = docs.select("uid", "text").join(small(held, held.limit(BROADCAST_ROWS + 1).count()), "uid", "left_semi")
    texts = texts.select("uid", _plain("text").alias("plain")).select("uid", F.posexplode(_pieces(F.col("plain"), wide, longest - 1)).alias("piece", "plain"))
    windows = texts.join(by_piece, ["uid", "piece"]).select("uid", "piece", _split(F.col("plain")).alias("words"), "places")
    windows = windows.select("uid", "piece", "words", F.explode("places").alias("p"))
    windows = windows.select("uid", "p.n", "p.start", "p.placed", F.slice("words", F.col("p.start") - F.col("piece") * wide + 1, F.col("p.n")).alias("words"))
    windows = windows.select("uid", "n", "start", "placed", _grams_for(F.col("words"), F.col("n")).alias("wgrams")).filter("size(wgrams) > 0")
    windows = scratch.put(windows.withColumn("wfp", _fingerprint(F.col("wgrams"))))
    indexed = items.select("item", "n", "fp", F.explode(_blocks(F.col("fp"))).alias("b"))
    asked = windows.select("uid", "n", "start", "wfp", F.explode(_blocks(F.col("wfp"))).alias("b"))
    near = (asked.join(small(indexed, sums["rows"] * (RADIUS + 1)), ["n", "b"])
            .filter(F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp"))) <= RADIUS).select("uid", "n", "start", "item").distinct())
    pairs = near.join(windows.select("uid", "n", "start", "placed", "wgrams"), ["uid", "n", "start"])
    pairs = pairs.join(small(items.select("item", "grams"), sums["grams"]), "item")
    exact = pairs.select("uid", "item", "start", "placed", F.col("n").alias("n_words"), _similarity(F.col("wgrams"), F.col("grams")).alias("similarity"))
    best = exact.filter(F.col("similarity") >= threshold).groupBy("uid", "item").agg(
        F.max(F.struct("similarity", "placed", (-F.col("start")).alias("s"), "n_words")).alias("m"))
    out = best.join(names, "item").select("uid", "item_id", F.col("m.similarity").alias("similarity"), (-F.col("m.s")).alias("start"), F.col("m.n_words").alias("n_words"))
    return docs.select("uid", "doc_id").join(out, "uid")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): every leak."""
    return leaks(C.keyed(docs), benchmark, threshold).drop("uid")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a leak."""
    rows = C.keyed(docs, whole=True)
    bad = C.Scratch(docs.sparkSession).put(leaks(rows, benchmark, threshold).select("uid").distinct())
    return rows.join(bad, "uid", "left_anti").select("row.*")
