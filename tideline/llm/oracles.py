"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

from tideline.llm import licenses, quality

EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size,
       d.doc_id IS NOT DISTINCT FROM g.keep_id
         AND row_number() OVER (PARTITION BY d.t, d.doc_id) = 1 AS kept,
       sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""

LINES = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
f AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
             row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k
      FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
w AS (SELECT doc_id, k, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS nth FROM w WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, k + x AS k FROM r, (VALUES (0), (1), (2)) v(x) WHERE nth > 1),
out_lines AS (
  SELECT l.doc_id, l.pos, l.line, f.k IS NOT NULL AS filled, gone.k IS NOT NULL AS removed
  FROM l LEFT JOIN f ON l.doc_id = f.doc_id AND l.pos = f.pos LEFT JOIN gone ON gone.doc_id = f.doc_id AND gone.k = f.k),
spans AS (
  SELECT *, max(CASE WHEN removed THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS before,
         last_value(CASE WHEN filled THEN removed END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prev,
         first_value(CASE WHEN filled THEN removed END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next
  FROM out_lines)
SELECT doc_id, count(*) FILTER (filled) AS n_lines, count(*) FILTER (removed) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT removed AND NOT (NOT filled AND coalesce(prev, false) AND coalesce(next, false))), '')) AS clean_sha256
FROM spans GROUP BY doc_id
"""


def _quality() -> str:
    ratio = {
        "n_words": "n_words",
        "mean_word_chars": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END",
        "symbol_ratio": "CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END",
        "stop_word_ratio": "CASE WHEN n_words > 0 THEN (n_stop_words + 1) / n_words ELSE 0 END",
        "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
        "repeat_word_ratio": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END",
    }
    broken = []
    for name, low, high in quality.RULES:
        tests = [f"{ratio[name]} < {low}"] * (low is not None) + [f"{ratio[name]} > {high}"] * (high is not None)
        broken.append((name, " OR ".join(tests)))
    failed = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in broken) + " END"
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ws AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
wr AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM ws),
win AS (SELECT doc_id, k, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS s
        FROM wr WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
rep AS (SELECT doc_id, k FROM win WHERE s IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT k + x) AS n_repeat_words FROM rep, (VALUES (0), (1), (2), (3), (4)) v(x) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln
       WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws.w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lc.n_dup_lines, 0) AS n_dup_lines, coalesce(cov.n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(ws.w, lambda x: lower(x) IN ({stops}))) AS n_stop_words, coalesce(lc.n_lines, 0) AS n_lines
  FROM d JOIN ws USING (doc_id) LEFT JOIN lc USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {failed} AS failed_rule FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, base_failed, failed_rule,
       NOT base_failed AND failed_rule IS NULL AS kept
FROM b
"""


def _licenses() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.TEMPLATES)
    words = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    grams = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))"
    return f"""
WITH t(license_id, body) AS (VALUES {values}),
tw AS (SELECT license_id, {words.format('body')} AS w FROM t),
ts AS (SELECT DISTINCT license_id, unnest({grams}) AS s FROM tw),
n AS (SELECT license_id, count(*) AS n_shingles FROM ts GROUP BY license_id),
dw AS (SELECT doc_id, {words.format('text')} AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest({grams}) AS s FROM dw)
SELECT doc_id, license_id, n_shingles, count(*) AS n_matched, round(count(*) / n_shingles, 6) AS containment
FROM ds JOIN ts USING (s) JOIN n USING (license_id)
GROUP BY doc_id, license_id, n_shingles HAVING count(*) / n_shingles >= {licenses.CONTAINMENT}
"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_table() -> list[int]:
    """The bytewise table of crc32, by its rule."""
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ 0xEDB88320 if x & 1 else x >> 1 for x in table]
    return table


def _spelling() -> str:
    return f"""
WITH RECURSIVE k AS (SELECT {_crc_table()}::BIGINT[] AS crc),
r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL HAVING length(run) >= 7),
x AS (SELECT *, hex(encode(doc_id::VARCHAR || ':' || run)) AS hx FROM c),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hx), 2), lambda i: ('0x' || hx[i:i+1])::BIGINT)),
        lambda acc, b: xor(acc // 256, crc[(xor(acc, b) & 255) + 1])), 4294967295) AS h FROM x, k),
s AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
v AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n FROM v a JOIN v b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word
      UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS best, max(n) AS best_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
      FROM w LEFT JOIN b USING (word)),
t AS (SELECT word, word AS tip, 0 AS d FROM f UNION ALL SELECT t.word, f.form, d + 1 FROM t JOIN f ON t.tip = f.word WHERE f.form IS NOT NULL),
z AS (SELECT word, last(tip ORDER BY d) AS root FROM t GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
"""


DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
ix AS (SELECT item_id, w, least(len(w), 10) AS k FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM ix)),
dp AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dp.k, item_id FROM dp JOIN win ON dp.s = win.s AND dp.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

SEARCH = f"""
WITH dt AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM documents),
q AS (SELECT item_id, t, count(*) AS times FROM
      (SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
dl AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
st AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM dl),
tf AS (SELECT doc_id, t, count(*) AS tf FROM dt SEMI JOIN q USING (t) GROUP BY ALL),
wt AS (SELECT t, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, st GROUP BY t),
im AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))) AS x FROM tf JOIN dl USING (doc_id) JOIN wt USING (t), st),
sc AS (SELECT item_id, doc_id, sum(times * x)::BIGINT AS score FROM q JOIN im USING (t) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM sc WHERE score > 0 QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": EXACT,
        "op5_quality_rules": _quality(),
        "op7_license_scan": _licenses(),
        "op10_line_dedup": LINES,
        "op11_spelling_variants": _spelling(),
        "op12_decontamination": DECONTAMINATION,
        "op13_lexical_search": SEARCH,
    }
