"""SQL (DuckDB) for the operators that SQL can express."""

from __future__ import annotations

from . import mixing, rules

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), least_ AS (SELECT a, min(b) AS m FROM reach GROUP BY a), links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN least_ ON least_.a = vec_id LEFT JOIN links ON links.a = vec_id
"""

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), pairs AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), reach(a, b) AS (
  SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), least_ AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_ ON a = d.doc_id
"""


def _rules() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    classes, rest, steps = [], "joined", []
    for name, pattern in rules.CLASSES:
        steps.append(f"regexp_replace({rest}, {quoted(pattern)}, '', 'g') AS after_{name}")
        classes.append(f"length({rest}) - length(after_{name})")
        rest = f"after_{name}"
    classes += [f"length({rest})", "chars - length(joined)"]
    cascade = "cut0 AS (SELECT * FROM docs)"
    for k, step in enumerate(steps):
        cascade += f", cut{k + 1} AS (SELECT *, {step} FROM cut{k})"
    common = "[" + ", ".join(map(quoted, rules.COMMON_WORDS)) + "]"
    symbols = "".join("\\" + c for c in rules.SYMBOLS)
    shares = lambda c: f"list_transform({c}, lambda x: CASE WHEN list_sum({c}) > 0 THEN x / list_sum({c}) ELSE 0.0 END)"
    half = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0.0 END"
    distance = lambda p, q: f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {half(f'{p}[i]', f'{q}[i]')} + {half(f'{q}[i]', f'{p}[i]')})) / 2))"
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{k + 1}])" for k in range(n)) + "]"
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, {WORDS} AS w, array_to_string({WORDS}, '') AS joined, length(coalesce(text, '')) AS chars FROM documents
), {cascade}, windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, array_to_string(w[i:i + 4], ' ') AS s FROM docs WHERE len(w) >= 5)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows, (SELECT unnest(range(5)) AS k) WHERE c > 1 GROUP BY doc_id
), counted AS (
  SELECT doc_id, lang, len(w) AS n_words, length(joined) AS word_chars, length(t) - length(regexp_replace(t, '[{symbols}]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, list_transform([{", ".join(classes)}], lambda x: x::DOUBLE) AS classes,
    list_transform({common}, lambda c: len(list_filter(w, lambda x: x = c))::DOUBLE) AS found FROM cut{len(steps)}
), full_ AS (
  SELECT *, list_append(found, n_words - coalesce(list_sum(found), 0)) AS commons FROM counted
), whole AS (
  SELECT {sums("classes", len(rules.CLASSES) + 2)} AS c, {sums("commons", len(rules.COMMON_WORDS) + 1)} AS m FROM full_
), own AS (
  SELECT lang, {sums("classes", len(rules.CLASSES) + 2)} AS c, {sums("commons", len(rules.COMMON_WORDS) + 1)} AS m, sum(n_words) AS n FROM full_ GROUP BY lang
), refs AS (
  SELECT lang, CASE WHEN n >= {rules.LEAST_REFERENCE} THEN own.c ELSE whole.c END AS c, CASE WHEN n >= {rules.LEAST_REFERENCE} THEN own.m ELSE whole.m END AS m FROM own, whole
), shared AS (
  SELECT f.*, {shares("classes")} AS p1, {shares("c")} AS q1, {shares("commons")} AS p2, {shares("m")} AS q2, coalesce(n_repeat_words, 0) AS reps FROM full_ f JOIN refs USING (lang) LEFT JOIN covered USING (doc_id)
), measured AS (
  SELECT *, {distance("p1", "q1")} AS d1, {distance("p2", "q2")} AS d2, n_words < 10 OR 100 * reps > 20 * n_words AS failed FROM shared
)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, reps AS n_repeat_words, failed AS base_failed,
  NOT failed AND NOT ((word_chars >= {rules.LEAST_CHARS} AND d1 > {rules.MOST_CLASS}) OR (n_words >= {rules.LEAST_WORDS} AND d2 > {rules.MOST_COMMON})) AS kept, round(d1, 6) AS class_distance, round(d2, 6) AS common_distance FROM measured
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embeddings": EMBEDDINGS, "op5_mixing": mixing.SQL, "op7_rules": _rules(), "op10_jaccard": JACCARD}
