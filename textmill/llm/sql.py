"""DuckDB SQL for the queries that SQL can express.  It states the results directly, not the methods."""

from __future__ import annotations

from textmill.llm.divergence import CLASSES, SYMBOLS, Rules

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

#: op10: exact Jaccard similarity of shingle sets over pairs that share a shingle, and components.
OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT s.*, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.f, s.x) AS r FROM s JOIN (SELECT x, count(*) AS f FROM s GROUP BY x) f USING (x) JOIN n USING (doc_id)),
prefix AS (SELECT doc_id, x, n FROM rare WHERE r <= n - ceil(0.85 * n - 1e-9) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.doc_id < b.doc_id),
common AS (SELECT a, b, count(*) AS c FROM pairs JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b AND q.x = p.x GROUP BY a, b),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS least FROM both_ UNION SELECT b.b, r.least FROM reach r JOIN both_ b ON b.a = r.id WHERE r.least < b.b),
comp AS (SELECT id, min(least) AS component FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = d.doc_id
"""

#: op9: cosine of all pairs with one label, and components.
OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS id, a AS least FROM links UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.id WHERE r.least < l.b),
comp AS (SELECT id, min(least) AS component FROM reach GROUP BY id), n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT d.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings d LEFT JOIN n ON n.id = vec_id LEFT JOIN comp ON comp.id = vec_id
"""

_RULES = Rules()
_K = _RULES.common_words


def _rest(i: int) -> str:
    """The text after the first i classes have been taken from it."""
    out = "t"
    for pattern in CLASSES[:i]:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return out


def _counts(text: str) -> str:
    n = len(CLASSES)
    parts = [f"length({_rest(i)}) - length({_rest(i + 1)})" for i in range(n)] + [f"length({_rest(n)})"]
    return "[" + ", ".join(("0" if i == 1 else p) for i, p in enumerate(parts)).replace("(t", f"({text}").replace("(t,", f"({text},") + "]"


def _distance(p: str, q: str) -> str:
    half = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0.0::DOUBLE END"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {half.format('z[1]', 'z[2]')} + {half.format('z[2]', 'z[1]')})) / 2, 0.0))"


#: op8: the same histograms and distances over the same references.
OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, {_WORDS.format('text')} AS w FROM documents),
known AS (SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {_RULES.min_docs}),
o AS (SELECT lang, unnest(w) AS t FROM d),
c AS (SELECT lang, t, count(*) AS n FROM o GROUP BY lang, t),
cc AS (SELECT lang, n, {_counts('t')} AS k FROM c),
cs AS (SELECT lang, list_value({', '.join(f'sum(k[{i}] * n)::DOUBLE' for i in range(1, len(CLASSES) + 2))}) AS s FROM (SELECT cc.* FROM cc SEMI JOIN known USING (lang) UNION ALL SELECT NULL, n, k FROM cc) GROUP BY lang),
wc AS (SELECT lang, w, sum(n) AS n FROM (SELECT lang, lower(t) AS w, n FROM c SEMI JOIN known USING (lang) UNION ALL SELECT NULL, lower(t), n FROM c) GROUP BY lang, w),
wr AS (SELECT lang, w, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r, sum(n) OVER (PARTITION BY lang) AS total FROM wc),
wt AS (SELECT lang, list(w ORDER BY r) AS words, list(n::DOUBLE / total ORDER BY r) AS share FROM wr WHERE r <= {_K} GROUP BY lang),
refs AS (SELECT cs.lang, words, list_transform(range(1, {_K + 2}), lambda i: CASE WHEN i <= {_K} THEN coalesce(share[i], 0) ELSE 1 - list_sum(share) END) AS word_share, list_transform(s, lambda x: x / greatest(list_sum(s), 1)) AS class_share FROM cs JOIN wt ON cs.lang IS NOT DISTINCT FROM wt.lang),
h AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) AS g FROM d WHERE len(w) >= 5),
rep AS (SELECT rid, i FROM h QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (SELECT d.*, len(w) AS nw, {_counts('t')} AS k, coalesce(cov.n, 0) AS nr, coalesce(l.n, 0) AS nd, coalesce(r.words, p.words) AS words, coalesce(r.word_share, p.word_share) AS ws, coalesce(r.class_share, p.class_share) AS cls
  FROM d LEFT JOIN cov USING (rid) LEFT JOIN l USING (rid) LEFT JOIN refs r ON r.lang = d.lang LEFT JOIN refs p ON p.lang IS NULL),
g AS (SELECT *, list_transform(range(1, {_K + 2}), lambda i: CASE WHEN i <= {_K} THEN len(list_filter(w, lambda x: lower(x) = words[i])) ELSE nw - len(list_filter(w, lambda x: list_contains(words, lower(x)))) END::DOUBLE / nw) AS wb,
  list_transform(k, lambda x: x::DOUBLE / list_sum(k)) AS cb, nw < {_RULES.min_words_base} OR 100 * nr > {_RULES.max_repeat_percent} * nw AS failed FROM f)
SELECT doc_id, nw::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, nd::BIGINT AS n_dup_lines, nr AS n_repeat_words, failed AS base_failed,
  CASE WHEN failed THEN false ELSE NOT coalesce(nw >= {_RULES.min_words} AND {_distance('wb', 'ws')} > {_RULES.max_word_distance}, false) AND NOT coalesce(length(t) >= {_RULES.min_chars} AND {_distance('cb', 'cls')} > {_RULES.max_class_distance}, false) END AS kept FROM g
"""

#: op6: which 100-byte strings of the documents' bytes stand earlier, and the bytes that they cover.  Bytes are taken as hexadecimal digits.
OP6 = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
g AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(length(x) // 2 - 99, 0))) AS i FROM d)),
later AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
runs AS (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER w, -1000) + 100 THEN 1 ELSE 0 END AS first FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, k, min(i) AS b, max(i) + 100 AS e FROM (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM runs) GROUP BY doc_id, k),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, list(b ORDER BY b) AS bs, list(e ORDER BY b) AS es FROM spans GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN cut.doc_id IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(bs) + 2), lambda k: substr(x, 2 * CASE WHEN k = 1 THEN 0 ELSE es[k - 1] END + 1,
    2 * (CASE WHEN k > len(bs) THEN length(x) // 2 ELSE bs[k] END - CASE WHEN k = 1 THEN 0 ELSE es[k - 1] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
