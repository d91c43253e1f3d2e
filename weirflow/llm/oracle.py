"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .pii import BASE, CONTEXT_CHARS, KINDS, MIN_SCORE
from .quality import POLICIES, RULES, SYMBOLS

WORD = r"[^\x20\x09-\x0D]+"


def _op8() -> str:
    # w: words; win: 8-word windows as lists; rep: positions whose window occurs again
    bits = " | ".join(f"(CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END)" for r in RULES)
    mask = POLICIES["standard", 1].mask
    symbols = "[" + "".join("\\" + c if c in "*$|" else c for c in SYMBOLS) + "]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
p AS (SELECT rid, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM a),
win AS (SELECT rid, i, x, lag(x) OVER o AS before, CASE WHEN lead(x, 7) OVER o IS NOT NULL THEN
        string_agg(x, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS g
        FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i, x, before, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 THEN 1 ELSE 0 END AS r FROM win),
cov AS (SELECT rid, i, x, before, max(r) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM rep),
n AS (SELECT rid, sum(c) AS n_repeat_words, count(*) FILTER (before = x) AS st FROM cov GROUP BY rid),
m AS (SELECT a.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '{symbols}', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
        CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(st, 0) AS BIGINT) AS n_stutter FROM a LEFT JOIN n ON a.rid = n.rid),
b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       (fail_bits & {mask}) = 0 AS kept, fail_bits FROM b"""


def _op7() -> str:
    # on hexadecimal text, two characters a byte: substrings by position, every window's hash, islands of windows
    return """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 399)) AS p FROM d)),
s AS (SELECT rid, p FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
f AS (SELECT rid, p, CASE WHEN p > lag(p) OVER (PARTITION BY rid ORDER BY p) + 400 THEN 1 ELSE 0 END AS new FROM s),
g AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS i FROM f),
r AS (SELECT rid, i, min(p) AS a, max(p) + 400 AS b FROM g GROUP BY rid, i),
q AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM r),
t AS (SELECT q.rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
      string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM q JOIN d ON q.rid = d.rid GROUP BY q.rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t ON d.rid = t.rid"""


def _op9() -> str:
    """Each kind's matches and the gaps between them, places by running sums, checks as list expressions."""
    digits = "regexp_replace({x}, '[^0-9]', '', 'g')"
    luhn = (
        "list_sum(list_transform(string_split(reverse({d}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) "
        "WHEN CAST(c AS INTEGER) > 4 THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0"
    )
    flat = "regexp_replace({x}, '[^A-Z0-9]', '', 'g')"
    number = "list_transform(string_split(substr({f}, 5) || substr({f}, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END)"
    mod = f"list_reduce(list_transform(string_split(array_to_string({number}, ''), ''), lambda c: CAST(c AS INTEGER)), lambda a, c: (a * 10 + c) % 97) = 1"
    checks = {
        "ip": "len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0",
        "card": f"CASE WHEN length({digits.format(x='x')}) BETWEEN 14 AND 19 THEN {luhn.format(d=digits.format(x='x'))} ELSE false END",
        "phone": f"length({digits.format(x='x')}) BETWEEN 10 AND 15",
        "iban": f"CASE WHEN length({flat.format(x='x')}) BETWEEN 15 AND 34 THEN {mod.format(f=flat.format(x='x'))} ELSE false END",
    }
    parts = []
    for rank, k in enumerate(KINDS):
        p = k.sql.replace("'", "''")
        parts.append(
            f"SELECT rid, {rank} AS rank, '{k.name}' AS kind, x, n, g, sum(length(g) + length(x)) OVER (PARTITION BY rid ORDER BY n) AS stop, {k.score} AS base, '(?i)\b(?:{k.context})' AS near "
            f"FROM (SELECT rid, unnest(m) AS x, unnest(range(len(m))) AS n, unnest(g[1:len(m)]) AS g FROM (SELECT rid, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d))"
        )
    good = "CASE kind " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in checks.items()) + " ELSE true END"
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS)
    zero, more = (", ".join(f"CAST(coalesce(n_{k.name}, 0) AS BIGINT) AS n_{k.name}" for k in kinds) for kinds in (BASE, KINDS[len(BASE) :]))
    one = "kind || ':' || CAST(stop - length(x) AS VARCHAR) || ':' || CAST(stop AS VARCHAR)"
    order = "ORDER BY stop - length(x), rank"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(parts)}),
s AS (SELECT *, CASE WHEN regexp_matches(right(g, {CONTEXT_CHARS}), near) THEN least(1.0, base + 0.2) ELSE base END AS score FROM a WHERE {good}),
f AS (SELECT * FROM s WHERE rank < {len(BASE)} OR score >= {MIN_SCORE}),
r AS (SELECT rid, {counts}, string_agg({one}, ',' {order}) FILTER (rank < {len(BASE)}) AS b, string_agg({one}, ',' {order}) AS spans,
      string_agg(format('{{:.1f}}', CAST(score AS DOUBLE)), ',' {order}) AS scores FROM f GROUP BY rid)
SELECT doc_id, {zero}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, {more}, coalesce(scores, '') AS scores FROM d LEFT JOIN r ON d.rid = r.rid"""


def _op11() -> str:
    """The checksum by its table, pairs by words with one character left out or blanked, roots by recursion."""
    tab = "list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return rf"""
WITH RECURSIVE tab AS (SELECT list({tab} ORDER BY i) AS tab FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
keyed AS (SELECT id, w, count(*) AS k, hex(encode(id || ':' || w)) AS x FROM runs WHERE length(w) >= 7 GROUP BY id, w),
crc AS (SELECT w, k, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda p: CAST('0x' || substr(x, 2 * p + 1, 2) AS BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM keyed, tab),
kept AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM crc),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v),
blank AS (SELECT word, n, substr(word, 1, p - 1) || '*' || substr(word, p + 1) AS x FROM cut),
less AS (SELECT DISTINCT word, n, substr(word, 1, p - 1) || substr(word, p + 1) AS x FROM cut),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM blank a JOIN blank b ON a.x = b.x AND a.word <> b.word
   UNION ALL SELECT l.word, s.word, s.n FROM less l JOIN v s ON l.x = s.word UNION ALL SELECT s.word, l.word, l.n FROM less l JOIN v s ON l.x = s.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
r AS (SELECT word, word AS root, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.form = f.word)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN r ON f.word = r.word AND r.form IS NULL"""


def _op13() -> str:
    """Lines by matching, not by splitting; the parts as joined slices; the rebuilt text as the text itself."""
    h = [f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)" for k in range(4)]
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
        sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, least({h[0]} % (len(u) + 1), {h[1]} % (len(u) + 1)) AS a,
        greatest({h[0]} % (len(u) + 1), {h[1]} % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {h[2]} % 100 >= 100 THEN 'plain'
             WHEN {h[3]} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"op7_suffix_dedup": _op7(), "op8_quality_rules": _op8(), "op9_pii": _op9(), "op11_spelling_variants": _op11(), "op13_fim": _op13()}
