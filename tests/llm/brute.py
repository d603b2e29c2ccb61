"""Plain versions of the operators' contracts, for small fixtures."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ordered(rows):
    """Rows (doc_id, text) in the order that decides which is earlier."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def repeated_bytes(rows, length=100):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)] and kept bytes."""
    seen, out, kept = set(), [], []
    for doc, text in ordered(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            piece = raw[p:p + length]
            if piece in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(piece)
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
        kept.append((doc, rest))
    return out, kept


def repeated_words(rows, window=50):
    seen, out = set(), []
    for doc, text in ordered(rows):
        words = WORD.findall(text or "")
        gone, mine = bytearray(len(words)), []
        for p in range(len(words) - window + 1):
            piece = tuple(words[p:p + window])
            if piece in seen:
                gone[p:p + window] = b"\1" * window
            mine.append(piece)
        seen.update(mine)
        rest = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(rest.encode()).hexdigest()))
    return out


def shingle_set(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def near_components(rows, size=4):
    """[(doc_id, n_shingles, component_id, kept)] in the order of ``ordered``."""
    rows = ordered(rows)
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(doc, len(sets[i]), rows[root(i)][0], root(i) == i) for i, (doc, _) in enumerate(rows)]


PUNCTUATION = {ord(c): None for c in ".,;:!?\"'()[]{}<>|*#$%&@^~`_+=/\\-"}


def leaks(docs, items, threshold=0.8):
    """{(doc row, item row): (similarity, start, n_words)} over the windows
    that share a shingle with the item at the same place (drawn into the
    document where they would reach beyond it)."""
    split = lambda t: WORD.findall((t or "").lower().translate(PUNCTUATION))
    grams = lambda w, k: [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
    out = {}
    for d, (_, text) in enumerate(docs):
        words = split(text)
        for q, (_, passage) in enumerate(items):
            item = split(passage)
            n, k = len(item), min(5, len(item))
            if not n:
                continue
            room = max(0, len(words) - n)
            starts = {max(0, min(i - j, room)) for i, x in enumerate(grams(words, k)) for j, y in enumerate(grams(item, k)) if x == y}
            for start in starts:
                x, y = collections.Counter(grams(words[start:start + n], k)), collections.Counter(grams(item, k))
                both = sum((x & y).values())
                like = both / max(1, sum(x.values()) + sum(y.values()) - both)
                best = out.get((d, q))
                if like >= threshold and (best is None or (like, -start) > (best[0], -best[1])):
                    out[d, q] = like, start, n
    return out


def best_window(text, passage):
    """(similarity, start) of the first of the most similar of all windows."""
    words, item = (WORD.findall(t.lower().translate(PUNCTUATION)) for t in (text, passage))
    n, k = len(item), min(5, len(item))
    count = lambda w: collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    best, y = (0.0, 0), count(item)
    for start in range(max(0, len(words) - n) + 1):
        x = count(words[start:start + n])
        both = sum((x & y).values())
        best = max(best, (both / max(1, sum(x.values()) + sum(y.values()) - both), -start))
    return best[0], -best[1]


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1
