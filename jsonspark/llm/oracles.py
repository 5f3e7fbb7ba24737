"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .license_scan import TEMPLATES
from .license_scan import Settings as Licenses
from .quality_rules import RULES, VALUES, Settings

_S = Settings()
_WORD = r"[^\x20\x09-\x0D]"
_VALUES = " UNION ALL ".join(
    f"SELECT doc_id, stratum, '{r}' AS rule, {i} AS place, CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END AS v FROM f" for i, (r, (a, b)) in enumerate(VALUES.items())
)
_CUTOFFS = ", ".join(f"('{r}', {c})" for r, cutoffs in RULES.items() for c in cutoffs)
_EACH = _S.alpha / len(RULES)

QUALITY = rf"""
WITH w AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
v AS ({_VALUES}),
good AS (SELECT doc_id FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = 1),
held AS (
  SELECT stratum AS s, rule, v FROM v JOIN good USING (doc_id)),
tests AS (SELECT greatest(1, count(DISTINCT s) + max(CASE WHEN s IS NULL THEN 1 ELSE 0 END)) * {len(RULES)} * {max(map(len, RULES.values()))} AS n FROM held),
counted AS (
  SELECT s, held.rule, cutoff, count(*) AS good, count(*) FILTER (WHERE v > cutoff) AS lost FROM held JOIN (VALUES {_CUTOFFS}) AS c(rule, cutoff) ON c.rule = held.rule GROUP BY ALL),
tail AS (
  SELECT s, rule, cutoff, CASE WHEN lost > good * {_EACH} THEN 1.0 WHEN lost >= good THEN 1.0 ELSE list_sum(list_transform(range(0, lost + 1),
    lambda j: exp(lgamma(good + 1) - lgamma(j + 1) - lgamma(good - j + 1) + j * ln({_EACH}) + (good - j) * ln(1 - {_EACH})))) END AS p FROM counted),
cuts AS (SELECT s, rule, min(cutoff) FILTER (WHERE p <= {_S.delta} / (SELECT n FROM tests)) AS cutoff FROM tail GROUP BY s, rule),
verdict AS (
  SELECT v.doc_id, string_agg(CASE WHEN v.v > cuts.cutoff THEN v.rule END, ',' ORDER BY v.place) AS failed_rules
  FROM v LEFT JOIN cuts ON cuts.rule = v.rule AND cuts.s IS NOT DISTINCT FROM v.stratum GROUP BY v.doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {_S.min_words} OR 100 * n_repeat_words > {_S.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {_S.min_words} OR 100 * n_repeat_words > {_S.max_repeat_percent} * n_words) AND failed_rules IS NULL AS kept,
  stratum, coalesce(failed_rules, '') AS failed_rules
FROM f JOIN verdict ON verdict.doc_id = f.doc_id
"""

# Five-word shingles of a text, as strings: those of all words if there are fewer.
_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')".replace("\\\\", "\\")
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"

DECONTAMINATION = f"""
WITH i AS (SELECT row_number() OVER () AS item, item_id, w, len(w) AS size, {_SHINGLES} AS sh FROM (SELECT DISTINCT item_id, text, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
each AS (SELECT item, size, unnest(sh) AS h, unnest(range(len(sh))) AS q FROM i),
weight AS (SELECT h, ln(1 + (SELECT count(*) FROM i) / count(DISTINCT item)) AS weight FROM each GROUP BY h),
whole AS (SELECT item, sum(weight) AS whole FROM (SELECT DISTINCT item, h FROM each) JOIN weight USING (h) GROUP BY item),
d AS (SELECT doc_id, len(w) AS doc_words, {_SHINGLES} AS sh FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
p AS (SELECT doc_id, doc_words, unnest(sh) AS h, unnest(range(len(sh))) AS p FROM d),
hits AS (SELECT DISTINCT doc_id, doc_words, item, size, p, h, weight FROM p JOIN each USING (h) JOIN weight USING (h)),
starts AS (
  SELECT DISTINCT doc_id, item, greatest(0, least(s, doc_words - size)) AS s FROM (
    SELECT doc_id, item, doc_words, size, p AS s FROM hits UNION ALL SELECT doc_id, item, doc_words, size, p - q FROM (SELECT doc_id, item, doc_words, size, p.p, q FROM p JOIN each USING (h)))),
scored AS (
  SELECT doc_id, item, s, size, sum(weight) AS held FROM (SELECT DISTINCT doc_id, item, s, size, h, weight FROM starts JOIN hits USING (doc_id, item) WHERE p >= s AND p < s + greatest(size - 4, 1)) GROUP BY ALL),
good AS (SELECT doc_id, item_id, s, scored.size, round(held / whole, 12) AS similarity FROM scored JOIN whole USING (item) JOIN i USING (item) WHERE round(held / whole, 12) >= 0.8)
SELECT doc_id, item_id, CAST(s AS BIGINT) AS start_word, CAST(size AS BIGINT) AS n_words, round(similarity, 6) AS similarity
FROM good QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s, size DESC) = 1
"""

_L = Licenses()
_TEMPLATE_ROWS = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in TEMPLATES.items())

LICENSES = f"""
WITH t AS (
  SELECT license, len(w) AS size, greatest(1, len(w) // 8) AS step, len(w) + greatest(1, len(w) // 8) - 1 AS span, list_distinct({_SHINGLES}) AS t
  FROM (SELECT license, {_WORDS} AS w FROM (VALUES {_TEMPLATE_ROWS}) AS x(license, text))),
each AS (SELECT license, step, span, len(t) AS n, unnest(t) AS h FROM t),
d AS (SELECT doc_id, len(w) AS doc_words, {_SHINGLES} AS sh FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
p AS (SELECT doc_id, doc_words, unnest(sh) AS h, unnest(range(len(sh))) AS p FROM d),
hits AS (SELECT * FROM p JOIN each USING (h)),
starts AS (SELECT doc_id, license, doc_words, step, span, n, h, unnest(range(greatest(0, CAST(ceil((p + 5 - span) / step) AS BIGINT)), p // step + 1)) * step AS s FROM hits),
held AS (SELECT doc_id, license, s, least(span, doc_words - s) AS words, count(DISTINCT h) / n AS containment FROM starts GROUP BY doc_id, license, s, span, doc_words, n)
SELECT doc_id, license, CAST(s AS BIGINT) AS start_word, CAST(words AS BIGINT) AS n_words, CAST(containment AS DOUBLE) AS containment FROM held
WHERE containment >= {_L.containment} QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, s, words) = 1
"""

# Two hexadecimal digits stand for a byte.
PASSAGES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 49)) AS pos, x FROM d),
k AS (SELECT doc_id, pos, substr(x, 2 * pos + 1, 100) AS g FROM s),
low AS (SELECT g, min(doc_id) AS low FROM k GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, pos FROM k JOIN low USING (g) WHERE low < doc_id),
island AS (SELECT doc_id, pos, sum(CASE WHEN pos <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS n
  FROM (SELECT doc_id, pos, coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -100) AS before FROM gone)),
span AS (SELECT doc_id, n, min(pos) AS a, max(pos) + 50 AS b FROM island GROUP BY doc_id, n),
piece AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM span UNION ALL SELECT doc_id, max(b), 1000000000 FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(d.x, 2 * piece.x + 1, 2 * (piece.y - piece.x)), '' ORDER BY piece.x) AS k FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN d.x ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

# CRC-32 of a short ASCII text, by its table.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: ascii(substr(CAST(doc_id AS VARCHAR), k, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, crc.t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295::BIGINT)"""

LM_BASE = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS t),
d AS (
  SELECT doc_id, {_CRC} % 5 = 1 AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}+'), ' ') AS w FROM documents, crc),
tokens AS (SELECT doc_id, held_out, unnest(w) AS t FROM d),
counts AS (SELECT t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY t),
total AS (SELECT sum(c) AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(max(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 6) AS base_score
FROM tokens LEFT JOIN counts USING (t), total GROUP BY doc_id, held_out
"""

_KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)
)


def _found(kind: int, name: str, pattern: str, group: int, least: int) -> str:
    """Matches of a kind with their places: what lies before them and the matches before, added up."""
    return f"""SELECT doc_id, {kind} AS k, '{name}' AS kind, m[i] AS v, g[i] AS value, s, s + length(m[i]) AS e FROM (
      SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM (
        SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS gaps FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))
      WHERE length(g[i]) >= {least}"""


SECRET_BASE = f"""
WITH found AS ({' UNION ALL '.join(_found(i, *x) for i, x in enumerate(_KINDS))}),
sums AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id
"""
