"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others have hashes, trained models or tilings that SQL lacks; they are
tested against brute force.
"""

from __future__ import annotations

from . import chat, merkle, quality


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


def _escaped(column: str) -> str:
    out = f"replace({column}, {_quoted(chat.ESCAPE)}, {_quoted(chat.ESCAPE * 2)})"
    for c in chat.CONTROL:
        out = f"replace({out}, {_quoted(c)}, {_quoted(c[0] + chat.ESCAPE + c[1:])})"
    return out


_MARKS = len(chat.START) + len(chat.MIDDLE) + len(chat.END)
_SAID = "</s>[INST] ok [/INST]"

CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'),
e AS (SELECT *, {_escaped('role')} AS r, {_escaped('text')} AS x FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, x)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, x) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(x) + {_MARKS})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

_COUNTS = ", ".join(f"length(text) - length(translate(text, {_quoted(p)}, ''))" for p in quality.CHAR_CLASSES.values())
_SYMBOL = list(quality.CHAR_CLASSES).index("symbol") + 1

_JS = """sqrt(greatest(sum(
    CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0))"""
_BINS = [*quality.CHAR_CLASSES, "rest"]
_PARTS = ", ".join(f"('c', '{(_BINS.index(x) + 1) % len(_BINS)}', {k})" for k, part in enumerate(quality._PROSE_PARTS) for x in part)
_PROSE = ", ".join(f"({k}, {q}::DOUBLE)" for k, q in enumerate(quality.PROSE))

QUALITY = f"""
WITH parts(kind, bin, part) AS (VALUES {_PARTS}), prose(part, q) AS (VALUES {_PROSE}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS text FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, [{_COUNTS}] AS classes FROM d),
w AS (SELECT rid, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM l),
g AS (SELECT rid, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i FROM g WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
inside AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(3) r(k) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM (
  SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
common AS (SELECT rid, a, count(*) AS n FROM w WHERE list_contains({_listed(quality.COMMON_WORDS)}, a) GROUP BY rid, a),
facts AS (
  SELECT l.rid, doc_id, lang, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    classes[{_SYMBOL}] AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words,
    greatest(length(text), 1)::DOUBLE AS whole, length(text) - list_sum(classes) AS rest, classes
  FROM l LEFT JOIN lines USING (rid) LEFT JOIN inside USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts),
shares AS (
  SELECT rid, 'c' AS kind, generate_subscripts(classes, 1)::VARCHAR AS bin, unnest(classes) / whole AS p FROM judged
  UNION ALL SELECT rid, 'c', '0', rest / whole FROM judged
  UNION ALL SELECT judged.rid, 'w', b, coalesce(common.n, 0) / greatest(n_words, 1)::DOUBLE
    FROM judged, unnest({_listed(quality.COMMON_WORDS)}) u(b) LEFT JOIN common ON common.rid = judged.rid AND a = b
  UNION ALL SELECT rid, 'w', '', (n_words - coalesce((SELECT sum(n) FROM common WHERE common.rid = judged.rid), 0))
    / greatest(n_words, 1)::DOUBLE FROM judged),
compared AS (SELECT shares.*, lang FROM shares JOIN judged USING (rid) WHERE NOT base_failed AND n_words >= 100),
counted AS (SELECT lang, kind, bin, floor(p * 1000)::BIGINT AS v, count(*) AS c FROM compared GROUP BY ALL),
upto AS (SELECT *, sum(c) OVER (PARTITION BY lang, kind, bin ORDER BY v) AS n, sum(c) OVER (PARTITION BY lang, kind, bin) AS whole FROM counted),
medians AS (SELECT lang, kind, bin, min(v) / 1000.0::DOUBLE AS m FROM upto WHERE 2 * n >= whole GROUP BY ALL),
mids AS (SELECT lang, kind, bin, m / nullif(sum(m) OVER (PARTITION BY lang, kind), 0) AS q FROM medians),
away AS (SELECT rid, kind, {_JS} AS js FROM compared JOIN mids USING (lang, kind, bin) GROUP BY rid, kind),
near AS (SELECT rid FROM away GROUP BY rid HAVING bool_and(js <= CASE kind WHEN 'c' THEN 0.30 ELSE 0.55 END) IS TRUE AND count(js) = 2),
means AS (SELECT lang, kind, bin, avg(p) AS q, count(*) AS texts FROM compared JOIN near USING (rid) GROUP BY ALL),
alike AS (SELECT lang FROM (SELECT lang, part, sum(m.q) AS p, max(s.q) AS q FROM means m JOIN parts USING (kind, bin) JOIN prose s USING (part)
  GROUP BY lang, part) GROUP BY lang HAVING {_JS} <= 0.30),
refs AS (SELECT * FROM means WHERE EXISTS (FROM alike WHERE alike.lang = means.lang)),
plain AS (SELECT rid, {_JS} AS js FROM (SELECT rid, part, sum(p) AS p, max(q) AS q FROM compared JOIN parts USING (kind, bin) JOIN prose USING (part)
  GROUP BY rid, part) GROUP BY rid),
own AS (SELECT rid, kind, {_JS} AS js, max(texts) / (max(texts) + 20)::DOUBLE AS weight FROM compared JOIN refs USING (lang, kind, bin) GROUP BY rid, kind),
worst AS (SELECT plain.rid, coalesce(c.weight * c.js, 0) + (1 - coalesce(c.weight, 0)) * plain.js > 0.30
    OR coalesce(w.weight * w.js > 0.55, false) AS far
  FROM plain LEFT JOIN own c ON c.rid = plain.rid AND c.kind = 'c' LEFT JOIN own w ON w.rid = plain.rid AND w.kind = 'w')
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(far, false) AS kept
FROM judged LEFT JOIN worst USING (rid)"""

REPEATS = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT *, octet_length(b) AS n FROM d),
w AS (SELECT rid, doc_id, i, b[i:i + 49] AS x FROM s, LATERAL (SELECT unnest(range(1, n - 48)) AS i)
      WHERE n >= 50 AND doc_id IS NOT NULL),
gone AS (SELECT rid, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY x) < doc_id),
cut AS (SELECT rid, i, i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY rid ORDER BY i) IS NULL AS fresh FROM gone),
runs AS (SELECT rid, min(i) AS low, max(i) + 50 AS high FROM (
  SELECT *, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY i) AS k FROM cut) GROUP BY rid, k),
ends AS (SELECT rid, high AS a, coalesce(lead(low) OVER (PARTITION BY rid ORDER BY low), n + 1) AS z FROM runs JOIN s USING (rid)
  UNION ALL SELECT rid, 1, coalesce((SELECT min(low) FROM runs WHERE runs.rid = s.rid), n + 1) FROM s),
kept AS (SELECT rid, string_agg(CASE WHEN z > a THEN hex(b[a:z - 1]) ELSE '' END, '' ORDER BY a) AS h FROM ends JOIN s USING (rid) GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce((SELECT sum(high - low) FROM runs WHERE runs.rid = s.rid), 0)::BIGINT AS n_removed,
  (SELECT count(*) FROM runs WHERE runs.rid = s.rid)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM s JOIN kept USING (rid)"""

EXACT = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""

_FIELDS = " || ".join(
    f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in merkle.FIELDS)
_LOWER = _FIELDS.replace("text::", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')::")
_CRC = """(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda h, x: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END,
      xor(h, x)), 4294967295::BIGINT))"""


def _manifest(levels: int = 7, arity: int = 16) -> str:
    """Trees of up to ``arity`` to the power of ``levels`` leaves, a step per level."""
    steps, folds = [], []
    for tree, low, high in (("a", 0, levels), ("b", 0, levels)):
        key = "source" if tree == "a" else "1"
        if tree == "b":
            steps.append(f"b0 AS (SELECT 1 AS k, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM a{levels})")
        for k in range(low, high):
            by = "source" if tree == "a" else "k"
            steps.append(f"""{tree}r{k} AS MATERIALIZED (SELECT {by}, i // {arity} AS i, max(n) AS n, list(h ORDER BY i) AS run FROM {tree}{k} GROUP BY {by}, i // {arity})""")
            steps.append(f"""{tree}{k + 1} AS MATERIALIZED (SELECT {by}, i, (n + {arity - 1}) // {arity} AS n,
  CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {tree}r{k})""")
    state = "p0 AS (SELECT doc_id, source, i, n, h AS leaf, claimed AS f, '' AS sibs FROM a0)"
    steps.append(state)
    at = 0
    for tree in "ab":
        if tree == "b":
            steps.append(f"p{at + 1} AS (SELECT p.* REPLACE (b0.i AS i, b0.n AS n), 1 AS k FROM p{at} p JOIN b0 ON p.source IS NOT DISTINCT FROM b0.source)")
            at += 1
        for k in range(levels):
            by = "p.source IS NOT DISTINCT FROM r.source" if tree == "a" else "p.k = r.k"
            left = f"array_to_string(r.run[1:p.i % {arity}], '')"
            right = f"array_to_string(r.run[p.i % {arity} + 2:], '')"
            steps.append(f"""p{at + 1} AS MATERIALIZED (SELECT p.* REPLACE (p.i // {arity} AS i, (p.n + {arity - 1}) // {arity} AS n,
  CASE WHEN p.n = 1 THEN p.f ELSE sha256({left} || p.f || {right}) END AS f,
  CASE WHEN p.n = 1 THEN p.sibs ELSE p.sibs || {left} || {right} END AS sibs)
  FROM p{at} p JOIN {tree}r{k} r ON {by} AND r.i = p.i // {arity})""")
            at += 1
    return f"""
WITH a0 AS (SELECT doc_id, source, h, CASE WHEN {_CRC} IS NOT NULL AND xor({_CRC}, 4294967295) % 5 = 0 THEN lowered ELSE h END AS claimed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, sha256({_FIELDS}) AS h, sha256({_LOWER}) AS lowered FROM documents)),
{", ".join(steps)}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(sibs) AS proof_sha256, f AS folded_root, f = t.h AS verified
FROM p{at} p JOIN a{levels} s ON s.source IS NOT DISTINCT FROM p.source JOIN b{levels} t ON t.k = p.k"""


ORACLES: dict[str, str] = {
    "op4_repeated_passages": REPEATS, "op6_quality_rules": QUALITY, "op7_chat_format": CHAT,
    "op11_merkle_manifest": _manifest(), "op12_exact_dedup": EXACT,
}
