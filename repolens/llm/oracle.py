"""DuckDB SQL for the results that SQL can express on whole tables."""

from __future__ import annotations

from . import decontam, merkle, minhash, negatives, rlz, rules

SEP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SEP}'), lambda x: x <> '')"


def _shares(size: str, words: str = "ws", at: str = "i") -> str:
    """``size`` words from place ``at`` on, as one string."""
    return f"array_to_string({words}[{at}:{at} + {size} - 1], ' ')"


OP4 = f"""WITH d AS (SELECT doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, {_shares(str(rlz.WINDOW))} AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {rlz.WINDOW} + 2)) AS i FROM d)),
fst AS (SELECT g, min(doc_id) AS doc FROM win GROUP BY g),
rep AS (SELECT win.doc_id, win.i FROM win JOIN fst ON fst.g = win.g WHERE fst.doc < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM rep, range(0, {rlz.WINDOW}) r(k)),
every AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.p) AS t
         FROM every e ANTI JOIN gone USING (doc_id, p) GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

OP7 = f"""WITH RECURSIVE d AS (SELECT doc_id, {words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, {_shares('4')} AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {minhash.PERCENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

OP10 = f"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t, {words("coalesce(text, '')")} AS ws,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
g AS (SELECT rid, i, {_shares('3')} AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) x WHERE n > 1),
v AS (SELECT rid, count(DISTINCT i + k) AS n FROM c, range(0, 3) r(k) GROUP BY rid),
b0 AS (SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{SEP}', '', 'g')) AS BIGINT) AS word_chars,
              CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
              CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words
       FROM w LEFT JOIN v ON v.rid = w.rid),
b AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b0),
h AS (SELECT host, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f FROM b WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT coalesce(sum(f) / sum(n), 0) AS mean FROM h),
s AS (SELECT mean, avg((f / n - mean) * (f / n - mean)) - avg(mean * (1 - mean) / n) AS excess FROM h, m GROUP BY mean),
k AS (SELECT mean, CASE WHEN excess <= 0 OR mean <= 0 OR mean >= 1 THEN {rules.MOST_PRIOR}
                        ELSE least({rules.MOST_PRIOR}, greatest(0.01, mean * (1 - mean) / excess - 1)) END AS k FROM s),
q AS (SELECT host, (f + mean * k) / (n + k) AS rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (b.host IS NULL OR rate <= {rules.HOST_LIMIT}) AS kept, b.host, round(coalesce(rate, mean), 6) AS host_rate
FROM b LEFT JOIN q ON q.host = b.host, m"""

_PUNCT = decontam.PUNCTUATION.replace("'", "''")
_PLAIN = words(f"translate(lower(coalesce(text, '')), '{_PUNCT}', '')")
OP1 = f"""WITH i AS (SELECT row_number() OVER () AS q, item_id, ws, len(ws) AS n, least(len(ws), {decontam.SHINGLE}) AS k
                FROM (SELECT item_id, {_PLAIN} AS ws FROM benchmark) x WHERE len(ws) > 0),
ig AS (SELECT q, n, k, j, {_shares('k', at='j')} AS g FROM (SELECT q, n, k, ws, unnest(range(1, n - k + 2)) AS j FROM i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN} AS ws FROM documents),
dg AS (SELECT rid, k, p, size, {_shares('k', at='p')} AS g FROM (
         SELECT rid, ws, len(ws) AS size, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) z)),
st AS (SELECT DISTINCT dg.rid, ig.n, ig.k, greatest(0, least(p - j, greatest(size - n, 0))) AS s
       FROM dg JOIN ig ON ig.g = dg.g AND ig.k = dg.k),
wg AS (SELECT st.rid, st.n, st.s, dg.g, count(*) AS c FROM st JOIN dg ON dg.rid = st.rid AND dg.k = st.k AND dg.p > st.s AND dg.p <= st.s + st.n - st.k + 1
       GROUP BY 1, 2, 3, 4),
wt AS (SELECT rid, n, s, sum(c) AS c FROM wg GROUP BY 1, 2, 3),
ic AS (SELECT q, n, g, count(*) AS c FROM ig GROUP BY 1, 2, 3),
it AS (SELECT q, sum(c) AS c FROM ic GROUP BY 1),
bo AS (SELECT wg.rid, wg.n, wg.s, ic.q, sum(least(wg.c, ic.c)) AS c FROM wg JOIN ic ON ic.g = wg.g AND ic.n = wg.n GROUP BY 1, 2, 3, 4),
sm AS (SELECT bo.rid, bo.q, bo.n, bo.s, bo.c / (wt.c + it.c - bo.c) AS like_
       FROM bo JOIN wt ON wt.rid = bo.rid AND wt.n = bo.n AND wt.s = bo.s JOIN it ON it.q = bo.q),
rk AS (SELECT *, row_number() OVER (PARTITION BY rid, q ORDER BY like_ DESC, s) AS r FROM sm WHERE like_ >= {decontam.THRESHOLD})
SELECT d.doc_id, i.item_id, like_ AS similarity, CAST(s AS INTEGER) AS start, CAST(rk.n AS INTEGER) AS n_words
FROM rk JOIN d ON d.rid = rk.rid JOIN i ON i.q = rk.q WHERE r = 1"""

# crc32 of a short text, byte by byte and bit by bit
def _crc32(text: str) -> str:
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen({text}) + 1), lambda i: CAST(ascii({text}[i]) AS BIGINT))), lambda c, b: {bits}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(text if c == "text" else c) for c in merkle.FIELDS) + ")"


def _flanks(nodes: str) -> str:
    """What stands beside each node of a level that has more than one."""
    side = lambda cmp: f"coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos {cmp} x.pos), '')"
    return (f"SELECT x.key, x.l, x.pos, {side('<')} AS lft, {side('>')} AS rgt FROM {nodes} x JOIN {nodes} y ON y.key = x.key AND y.l = x.l AND y.pos // 3 = x.pos // 3 "
            f"JOIN (SELECT key, max(l) AS top FROM {nodes} GROUP BY key) t ON t.key = x.key AND x.l < t.top GROUP BY 1, 2, 3")


def _raised(name: str, first: str) -> str:
    return (f"{name}(key, l, pos, h) AS ({first} UNION ALL SELECT key, l + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) "
            f"FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {name}) x WHERE n > 1 GROUP BY key, l, pos // 3)")


OP11 = f"""WITH RECURSIVE
f AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('1' || source, '0') AS key, {_leaf('text')} AS leaf,
             CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS now FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM f),
{_raised('lv', 'SELECT key, 0, pos, leaf FROM n')},
sub AS (SELECT key, arg_max(h, l) AS h FROM lv GROUP BY key),
num AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS pos FROM sub),
{_raised('up', "SELECT '', 0, pos, h FROM num")},
rt AS (SELECT arg_max(h, l) AS root FROM up),
fl AS ({_flanks('lv')}),
fu AS ({_flanks('up')}),
st AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY step) AS k, lft, rgt FROM (
         SELECT n.rid, fl.l AS step, lft, rgt FROM n JOIN fl ON fl.key = n.key AND fl.pos = n.pos // CAST(power(3, fl.l) AS BIGINT)
         UNION ALL SELECT n.rid, 1000 + fu.l, lft, rgt FROM n JOIN num ON num.key = n.key JOIN fu ON fu.pos = num.pos // CAST(power(3, fu.l) AS BIGINT)) x),
pr AS (SELECT rid, string_agg(lft || rgt, '' ORDER BY k) AS p, count(*) AS k FROM st GROUP BY rid),
fo(rid, k, h) AS (SELECT rid, 0, coalesce(now, leaf) FROM n
                  UNION ALL SELECT fo.rid, fo.k + 1, sha256(lft || h || rgt) FROM fo JOIN st ON st.rid = fo.rid AND st.k = fo.k + 1)
SELECT n.doc_id, n.leaf, sub.h AS subroot, root, sha256(coalesce(p, '')) AS proof_sha256, fo.h AS folded_root, fo.h = root AS verified
FROM n JOIN sub ON sub.key = n.key LEFT JOIN pr ON pr.rid = n.rid JOIN fo ON fo.rid = n.rid AND fo.k = coalesce(pr.k, 0), rt"""

OP12 = f"""WITH v AS (SELECT row_number() OVER () AS u, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({negatives.SCALE} * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.u AS au, a.id AS anchor_id, v.u, v.id, v.label = a.label AS same, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
      FROM v a, v WHERE a.id % 100 = 0 AND a.u <> v.u),
p AS (SELECT au, anchor_id, u, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY au ORDER BY score DESC, id, u) <= {negatives.POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.au, p.u ORDER BY s.score DESC, s.id, s.u) AS INTEGER) AS rank,
       s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.au = p.au AND NOT s.same AND {negatives.LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {negatives.HIGH} * positive_score
QUALIFY rank <= {negatives.NEGATIVES}"""

SQL = {
    "op1_decontamination": OP1,
    "op4_substring_dedup": OP4,
    "op7_minhash": OP7,
    "op10_host_rules": OP10,
    "op11_merkle_manifest": OP11,
    "op12_hard_negatives": OP12,
}
