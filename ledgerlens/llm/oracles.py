"""DuckDB SQL for the queries that SQL can express."""

from . import quality_rules as Q

_W = r"[^\x20\x09-\x0D]+"
_S = r"[\x20\x09-\x0D]+"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(line: str, chars: str) -> str:
    return f"(length({line}) - length(translate({line}, {_q(chars)}, '')))"


def _letters(t: str) -> str:
    return f"length(replace({t}, ' ', ''))"


def _words(t: str) -> str:
    return f"(length({t}) - {_letters(t)} + 1)"


def _is_open(line: str) -> str:
    return f"(right(rtrim({line}, {_q(Q.CLOSING)}), 1) NOT IN ({', '.join(map(_q, Q.ENDS))}))"


def _line_fails(t: str, following: str, in_menu: str) -> str:
    """t: a trimmed line."""
    words, letters, seps, exclaimed = _words(t), _letters(t), _count(t, Q.SEPARATORS), _count(t, Q.EXCLAMATIONS)
    c = f"left(trim({following}, ' '), 1)"
    phrases = " OR ".join(f"contains(lower({t}), {_q(p)})" for p in Q.BOILERPLATE)
    capitals = f"length(regexp_replace({t}, '\\P{{Lu}}+', '', 'g'))"
    return f"""(({words} >= {Q.OPEN_WORDS} AND {_is_open(t)} AND {Q.SENTENCE_WORDS} * {_count(t, Q.SENTENCE_ENDS)} < {words} AND NOT coalesce({c} = lower({c}) AND {c} <> upper({c}), false))
      OR ({seps} >= 2 AND {words} <= {Q.ITEM_WORDS} * ({seps} + 1) + {seps}) OR 100 * {_count(t, Q.MARKS)} > {Q.MAX_MARK_PERCENT} * {letters}
      OR ({exclaimed} >= 3 AND 4 * {exclaimed} >= {words}) OR (regexp_matches({t}, '\\p{{Lu}}\\p{{Lu}}') AND {words} >= 3 AND 2 * {capitals} > {letters})
      OR ({words} <= {Q.BOILERPLATE_WORDS} AND ({phrases})) OR ({in_menu} AND {words} <= {Q.SHORT_WORDS} AND {_is_open(t)}))"""


OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_W}') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls FROM d),
sep AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
nx AS (SELECT doc_id, x, trim(x, ' ') AS y, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM sep),
lines_ AS (SELECT *, count(*) FILTER ({_words('y')} <= {Q.SHORT_WORDS} AND {_is_open('y')}) OVER (PARTITION BY doc_id) AS menu,
           count(*) OVER (PARTITION BY doc_id) AS n FROM nx WHERE regexp_matches(x, '{_W}')),
lost AS (SELECT doc_id, sum(length(x))::BIGINT AS line_chars, coalesce(sum(length(x)) FILTER ({_line_fails('y', 'following', f'(menu >= {Q.MENU_LINES} AND 2 * menu > n)')}), 0)::BIGINT AS lost_chars
         FROM lines_ GROUP BY 1),
win AS (SELECT doc_id, u.i AS i, array_to_string(ws[u.i:u.i + {Q.WINDOW - 1}], ' ') AS k
        FROM w, unnest(range(1, len(ws) - {Q.WINDOW - 2})) AS u(i)),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + s.o) AS n FROM dup, range({Q.WINDOW}) AS s(o) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_S}', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{Q.SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        coalesce(line_chars, 0) AS line_chars, coalesce(lost_chars, 0) AS lost_chars
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words)
    AND 100 * lost_chars <= {Q.MAX_LOSS_PERCENT} * line_chars AS kept, line_chars, lost_chars
FROM m"""

OP10 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""



def _edit(state: str, cost: str, letters: str, line: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}', 't': {state}.t || {line}}}"


def _turn_states() -> str:
    """The four states after row r of conversation w, inserts before it included."""
    user, both = "chr(10) || 'user:'", "chr(10) || 'user:' || chr(10) || 'assistant:'"
    inserted = {
        "s2": ["s2", *(_edit(a, "3", "I", user) for a in ("s0", "s1", "s3"))],
        "s3": ["s3", _edit("s2", "3", "I", "chr(10) || 'assistant:'"), *(_edit(a, "6", "II", both) for a in ("s0", "s1"))],
    }
    return ", ".join(["s0", "s1", *(f"least({', '.join(x)}) AS {s}" for s, x in inserted.items())])


def _row_states() -> str:
    stay = "CASE WHEN blank OR again THEN 1000000000000 WHEN cut THEN 3 ELSE 0 END"
    options: list[list[str]] = [[_edit(f"s{k}", "4", "D", "''")] for k in range(4)]
    for a, role, b in ((0, "system", 1), (0, "user", 2), (1, "user", 2), (2, "assistant", 3), (3, "user", 2)):
        options[b].append(_edit(f"s{a}", f"{stay} + CASE WHEN left(role, 1) = '{role[0]}' THEN 0 ELSE 1000000000000 END", "K", "chr(10) || role || ':' || text"))
        if role != "system":
            options[b].append(_edit(f"s{a}", f"{stay} + 3", "R", f"chr(10) || '{role}:' || text"))
    return ", ".join(f"least({', '.join(x)}) AS s{k}" if len(x) > 1 else f"{x[0]} AS s{k}" for k, x in enumerate(options))


_NONE = "{'c': 1000000000000::BIGINT, 'a': '', 't': ''}"
OP12 = rf"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT k, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind
  FROM (SELECT DISTINCT k FROM named)),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM named JOIN kinds USING (k)),
numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM damaged),
placed AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid) > 1 AS seen, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, rid)),
flags AS MATERIALIZED (SELECT conv_id, turn, i, role, text, last = '' AS blank, last <> '' AND seen AS again, last <> '' AND NOT seen AND last NOT IN ('.', '!', '?') AS cut,
    pair NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
walk AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {_NONE} AS s1, {_NONE} AS s2, {_NONE} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, {_row_states()} FROM (
    SELECT w.conv_id, r.i, r.role, r.text, r.blank, r.again, r.cut, {_turn_states()} FROM walk w JOIN flags r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)),
ends AS (SELECT conv_id, least(s0, s3) AS e FROM (
  SELECT conv_id, {_turn_states()} FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM walk) WHERE back = 1)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (illegal) AS illegal FROM flags GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, e.e.c AS cost, e.e.a AS audit, sha256(substr(e.e.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""

OP11 = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT lang, source, r, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
n AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, coalesce(s.n, 0) + 2 * coalesce(v, 0) AS total FROM g LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM n GROUP BY ALL) s USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2)::HUGEINT // total::HUGEINT)::BIGINT AS p
  FROM totals JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 2)::HUGEINT // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang))::HUGEINT)::BIGINT AS q FROM n GROUP BY lang, term),
pairs AS (SELECT lang, a.source, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b USING (lang) LEFT JOIN (
    SELECT lang, a.source AS source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source WHERE a.source <> b.source),
tops AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM tops) WHERE rank <= 10"""

ORACLES = {"op11_divergence": OP11, "op12_turn_repair": OP12, "op7_quality_rules": OP7, "op10_exact_dedup": OP10}
