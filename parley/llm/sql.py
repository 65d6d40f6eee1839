"""DuckDB twins of the operators that SQL can express."""

from __future__ import annotations

from parley.llm import decontaminate, divergence, hard_negatives, mixing, quality, url_filter

_WORD = r"'[^\x20\x09-\x0D]+'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quality() -> str:
    measures = {
        "mean_word_length": "word_chars / greatest(n_words, 1)", "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "marks_per_word": "n_marks / greatest(n_words, 1)", "capital_share": "n_capitals / greatest(word_chars, 1)",
        "stop_word_share": "n_stop_words / greatest(n_words, 1)", "repeated_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "words_per_line": "n_words / greatest(n_lines, 1)",
    }
    bad = []
    for r in quality.RULES:
        m, sides = measures[r.measure], []
        if r.low is not None:
            sides.append(f"{m} < {r.low}")
        if r.high is not None:
            sides.append(f"{m} > {r.high}")
        bad.append(f"(n_words >= {r.min_words} AND ({' OR '.join(sides)}))")
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, {_WORD}) AS ws,
        list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANKS}) <> '') AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + {quality.WINDOW - 1}], ' ') AS k
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS i FROM w WHERE len(ws) >= {quality.WINDOW})),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS r FROM (SELECT rid, i, unnest(range({quality.WINDOW})) AS j FROM rep) GROUP BY rid),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(t) - len(regexp_extract_all(t, '[\\x20\\x09-\\x0D]')) AS word_chars,
        length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols, len(ls) AS n_lines,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.r, 0) AS n_repeat_words,
        len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
        length(t) - length(translate(t, '!?', '')) AS n_marks, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals
      FROM w LEFT JOIN cov ON cov.rid = w.rid),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {' OR '.join(bad)} AS bad FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM b"""


def _mixing() -> str:
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in mixing.WEIGHTS)
    return f"""
WITH m AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS size,
        length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{quality.SYMBOLS}', '')) AS symbols FROM documents),
k AS (SELECT doc_id, source, size,
        -ln((('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
          / greatest(0.5, 1.0 - symbols::DOUBLE / greatest(size, 1)) AS key FROM m),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, [{weights}][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight, {mixing.CAP} * source_size::DOUBLE AS most FROM s),
l AS (SELECT *, ({mixing.SHARE} * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(most) OVER o, 0.0))
          / ((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER o, 0.0)) AS level
      FROM r WINDOW o AS (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, level >= most / weight AS is_full FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE weight * (SELECT arg_min(level, most / weight) FROM f WHERE NOT is_full) END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
q AS (SELECT k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS need,
        coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN p ON p.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * (epochs + CASE WHEN 2 * before + size <= 2 * need THEN 1 ELSE 0 END))::BIGINT AS taken FROM q"""


CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|im_(start|end)\|>', '<\\\1|im_\2|>', 'g') AS written FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(written) + length('<|im_start|><|im_end|>') + 2)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def _urls() -> str:
    rule, verdict = "NULL", "NULL"
    for r in sorted(url_filter.RULES, key=lambda r: (len(r.text), len(r.host))):
        fits = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{r.text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{r.verdict}' ELSE {verdict} END"
    link = url_filter.LINK.replace("'", "''")
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, {lower.format("regexp_extract(coalesce(rest, ''), '(?s)^([^/?#]*)', 1)")} AS host,
        regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
j AS (SELECT *, {rule} AS rule, {verdict} AS ruled FROM h),
own AS (SELECT host, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked FROM j WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, dst, count(*)::DOUBLE AS weight FROM (
    SELECT host, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda x: {lower.format("x")}))) AS dst FROM j WHERE host <> '')
  WHERE dst <> host GROUP BY host, dst),
named AS (SELECT host FROM own UNION SELECT dst FROM links),
hosts AS (SELECT DISTINCT host FROM (SELECT host FROM named UNION ALL
    SELECT array_to_string(string_split(host, '.')[i:], '.') FROM (SELECT host, unnest(range(1, len(string_split(host, '.')))) AS i FROM named))),
up AS (SELECT host AS src, substr(host, instr(host, '.') + 1) AS dst, {url_filter.PARENT_WEIGHT}::DOUBLE AS weight FROM hosts WHERE len(string_split(host, '.')) > 2),
edges AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT * FROM up UNION ALL SELECT dst, src, weight FROM up) GROUP BY src, dst)"""]
    for name, seed, a, b in (("trust", "allowed", "src", "dst"), ("distrust", "blocked", "dst", "src")):
        parts.append(f"{name}_s AS (SELECT h.host, coalesce(o.{seed}, 0)::DOUBLE / greatest((SELECT sum({seed}) FROM own), 1) AS restart FROM hosts h LEFT JOIN own o ON o.host = h.host)")
        parts.append(f"{name}_e AS (SELECT {a} AS a, {b} AS b, weight / sum(weight) OVER (PARTITION BY {a}) AS share FROM edges)")
        # what is pending at a host, round by round; after 200 rounds 10^-14 of it is left
        parts.append(f"""{name}_p(k, host, pending) AS (SELECT 0, host, {1.0 - url_filter.DAMPING} * restart FROM {name}_s WHERE restart > 0
  UNION ALL SELECT k + 1, b, {url_filter.DAMPING} * sum(pending * share) FROM {name}_p JOIN {name}_e ON a = host WHERE k < 200 GROUP BY k, b)""")
        parts.append(f"{name} AS (SELECT host, sum(pending) AS rank FROM {name}_p GROUP BY host)")
    t, d = "coalesce(t.rank, 0) * c.n", "coalesce(d.rank, 0) * c.n"
    return ",\n".join(parts).replace("WITH u AS", "WITH RECURSIVE u AS", 1) + f"""
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.ruled, CASE WHEN {d} >= {url_filter.THRESHOLD} AND {d} > {t} + {url_filter.TOLERANCE} THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN trust t ON t.host = j.host LEFT JOIN distrust d ON d.host = j.host CROSS JOIN (SELECT count(*) AS n FROM hosts) c"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _divergence() -> str:
    share = f"1 + ({divergence.UNIT}::HUGEINT * (coalesce({{n}}, 0) + {divergence.SMOOTH})) // ({{total}} + {divergence.SMOOTH} * v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{divergence.TERM}') AS ts FROM documents),
w AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= {divergence.MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(t.total, 0) AS total, coalesce(k.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source) t USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) k USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share.format(n="c.n", total="total")} AS p
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, {share.format(n="n", total="total")} AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term)
  JOIN (SELECT lang, sum(total)::HUGEINT AS total, max(v) AS v FROM g GROUP BY lang) USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source) x ON x.lang = a.lang AND x.source = a.source AND x.other = b.source),
more AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - l.q)::BIGINT AS value FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.n > 0 AND p.p > l.q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM more))
WHERE part = 'pair' OR rank <= 50"""


def _decontaminate() -> str:
    word, size = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'", decontaminate.WINDOW
    gram = "array_to_string(ws[i:i + {n} - 1], ' ')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {word}) AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {word}) AS ws FROM benchmark),
win AS (SELECT DISTINCT item, n, {gram.format(n="n")} AS k FROM (
    SELECT item, ws, least(len(ws), {size}) AS n, unnest(range(1, greatest(len(ws) - {size}, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT rid, n, i, {gram.format(n="n")} AS k FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT rid, n, i, item FROM pos JOIN win USING (n, k)),
cov AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT rid, i, unnest(range(n)) AS j FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)"""


def _negatives() -> str:
    h = hard_negatives
    return f"""
WITH e AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(x::DOUBLE * {h.SCALE})) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.k, a.vec_id AS anchor_id, b.k AS o, b.vec_id AS other, a.label = b.label AS same, CASE WHEN len(a.v) = 0 THEN 0 ELSE list_dot_product(a.v, b.v) END::BIGINT AS score
  FROM e a JOIN e b ON a.k <> b.k AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, other, o) AS place FROM s WHERE same) WHERE place <= {h.POSITIVES}),
n AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
    (row_number() OVER (PARTITION BY p.k, p.place ORDER BY s.score DESC, s.other, s.o))::INTEGER AS rank
  FROM p JOIN s ON s.k = p.k AND NOT s.same AND {h.LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {h.MOST} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {h.NEGATIVES}"""


QUALITY_SQL, MIXING_SQL, URL_SQL = _quality(), _mixing(), _urls()
DIVERGENCE_SQL, DECONTAMINATE_SQL, NEGATIVES_SQL = _divergence(), _decontaminate(), _negatives()
