"""The registered queries as SQL, for comparison on the same tables."""

from __future__ import annotations

import re

from ..functions import rules, text
from ..operators import detect, policy, synth
from ..operators import word_pieces as pieces
from . import synth_sql
from .fixtures import ANNOTATED_CTE


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") t({names})"


def find_all(source: str, pattern: str, key: str = "id", col: str = "text", groups: tuple[int, ...] = ()) -> str:
    """Rows (key, i, start, end, value, g1, ...) of all matches in source."""
    p = q(pattern)
    g = "".join(f", regexp_extract_all({col}, {p}, {k}) AS gs{k}" for k in groups)
    pick = "".join(f", gs{k}[i] AS g{k}" for k in groups)
    length = lambda x, a, b: f"coalesce(list_sum(list_transform({x}[{a}:{b}], lambda v: length(v))), 0)"
    return f"""SELECT {key}, i, CAST({length('gaps', 1, 'i')} + {length('hits', 1, 'i - 1')} AS INT) AS start,
 CAST({length('gaps', 1, 'i')} + {length('hits', 1, 'i')} AS INT) AS "end", hits[i] AS value{pick}
 FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({col}, {p}) AS hits, regexp_split_to_array({col}, {p}) AS gaps{g} FROM {source}) x0) x1"""


def place_all(source: str, pattern: str, key: str = "id", col: str = "text") -> str:
    """find_all() for sources with a row for each key, by running sums: linear in the matches of a text."""
    p = q(pattern)
    return f"""SELECT {key}, i, CAST(upto - length(value) AS INT) AS start, CAST(upto AS INT) AS "end", value FROM (
 SELECT {key}, i, value, sum(length(gap) + length(value)) OVER (PARTITION BY {key} ORDER BY i) AS upto FROM (
  SELECT {key}, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS value, unnest(gaps[1:len(hits)]) AS gap FROM (SELECT {key}, regexp_extract_all({col}, {p}) AS hits, regexp_split_to_array({col}, {p}) AS gaps FROM {source}) x0) x1) x2"""


_MARK = rules.MARKER
_KNOWN = ", ".join(map(q, rules.LABELS))
_STRIP = f"regexp_replace(text, {q(_MARK)}, '\\1', 'g')"
#: Markers (id, i, start, end, value, label) and entities of known labels in the text without markers.
MARKERS = f"marks AS (SELECT id, i, start, \"end\", g1 AS value, g2 AS label FROM ({find_all('annotated', _MARK, groups=(1, 2))}) m0)"
ENTITIES = f"""ents AS (SELECT id, i, start, CAST(start + length(value) AS INT) AS "end", label, value FROM (
 SELECT id, i, value, label, CAST(start - coalesce(sum("end" - start - length(value)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM marks) e0
 WHERE label IN ({_KNOWN}))"""
CLEAN = f"clean AS (SELECT id, {_STRIP} AS text FROM annotated)"
EVERY = f"every AS (SELECT id, text FROM clean UNION ALL SELECT -doc_id - 1, text FROM documents)"
BASE = f"WITH {ANNOTATED_CTE}, {MARKERS}, {ENTITIES}, {CLEAN}, {EVERY}"


def word_pieces_cte(source: str, key: str) -> str:
    """CTEs (after WITH RECURSIVE) that end in pieces (key, pos, piece, id_, word, start, end) of the rows (key, i, word, shift, value) of
    source: runs with the number of their word and its place."""
    glue, unknown = q(pieces.GLUE), q("[UNK]")
    return f"""bench AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[0-9a-zà-ɏ]+')) AS w FROM benchmark),
vocab AS (SELECT piece, CAST(row_number() OVER (ORDER BY piece) + {len(pieces.SPECIAL) - 1} AS INT) AS id FROM (SELECT w AS piece FROM bench UNION SELECT left(w, n) FROM bench, range(1, 5) r(n) UNION SELECT {glue} || right(w, n) FROM bench, range(1, 5) r(n)) v),
runs AS ({source}),
forms AS (SELECT DISTINCT lower(value) AS form FROM runs WHERE length(value) <= {pieces.LONGEST}),
tried AS (SELECT form, spot, size, CASE WHEN spot > 0 THEN {glue} ELSE '' END || substr(form, spot + 1, size) AS piece FROM (SELECT form, spot, unnest(range(1, least(length(form) - spot, 40) + 1))::INT AS size FROM (SELECT form, unnest(range(0, length(form)))::INT AS spot FROM forms) t0) t1),
fits AS (SELECT form, spot, max(size) AS size FROM tried JOIN vocab USING (piece) GROUP BY ALL),
cut AS (SELECT form, spot, size, 0 AS k FROM fits WHERE spot = 0 UNION ALL SELECT f.form, f.spot, f.size, c.k + 1 FROM cut c JOIN fits f ON f.form = c.form AND f.spot = c.spot + c.size),
whole AS (SELECT form FROM cut WHERE spot + size = length(form)),
matched AS (SELECT c.form, c.k, c.spot, c.size, v.piece, v.id FROM cut c JOIN whole USING (form) JOIN vocab v ON v.piece = CASE WHEN c.spot > 0 THEN {glue} ELSE '' END || substr(c.form, c.spot + 1, c.size)),
spread AS (SELECT r.{key}, r.i, coalesce(m.k, 0) AS k, coalesce(m.piece, {unknown}) AS piece, coalesce(m.id, 1) AS id_, r.word, r.shift + coalesce(m.spot, 0) AS start, r.shift + coalesce(m.spot + m.size, length(r.value)) AS "end" FROM runs r LEFT JOIN matched m ON m.form = lower(r.value)),
pieces AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i, k) - 1 AS pos, piece, id_, word, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM spread)"""


#: A run's word is the last white-space word that begins before or with it.
DOCUMENT_PIECES = f"""WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), spaced AS ({place_all('texts', pieces.SPACE, 'doc_id')}),
{word_pieces_cte("SELECT r.doc_id, r.i, r.start AS shift, r.value, s.i - 1 AS word FROM (" + place_all('texts', pieces.RUN, 'doc_id') + ") r ASOF JOIN spaced s ON r.doc_id = s.doc_id AND r.start >= s.start", 'doc_id')}"""


def hits(source: str, key: str = "id") -> str:
    parts = [f"SELECT {key}, start, \"end\", {q(label)} AS label, value, {q('regex:' + name)} AS source, {q(tier)} AS tier, CAST({score} AS DOUBLE) AS score FROM ({find_all(source, pattern, key)}) h{k}" for k, (name, label, tier, score, pattern) in enumerate(rules.PATTERNS)]
    return " UNION ALL ".join(parts)


def ranked_hits(source: str, key: str = "id") -> str:
    """hits() with the place of the pattern in the catalogue."""
    names = "CASE source " + " ".join(f"WHEN {q('regex:' + name)} THEN {k}" for k, (name, *_) in enumerate(rules.PATTERNS)) + " END"
    return f"SELECT *, {names} AS pattern FROM ({hits(source, key)}) ranked"


def block_masked(col: str) -> str:
    out = col
    for _, label, tier, _, pattern in rules.PATTERNS:
        if tier == "block":
            out = f"regexp_replace({out}, {q(pattern)}, {q(rules.MASK_HEAD + label + rules.MASK_TAIL)}, 'g')"
    return out


def tier_case(label: str) -> str:
    return f"CASE WHEN {label} IN ({_KNOWN}) THEN 'block' ELSE 'warn' END"


def draw(key: str, slot: str, n: int) -> str:
    """slot: an SQL expression."""
    return f"CAST(CAST('0x' || substr(md5('42:' || CAST({key} AS VARCHAR) || ':' || {slot}), 1, 8) AS UBIGINT) % {n} AS BIGINT)"


def uniform(key: str, slot: str) -> str:
    return f"({draw(key, q(slot), 1 << 30)} / {float(1 << 30)})"


def weighted(u: str, weights: dict[str, float]) -> str:
    total, upto, out = sum(weights.values()), 0.0, ""
    names = list(weights)
    for n in names[:-1]:
        upto += weights[n] / total
        out += f" WHEN {u} < {upto!r} THEN {q(n)}"
    return f"CASE{out} ELSE {q(names[-1])} END"


def shape_value(shape: str, key: str, slot: str) -> str:
    parts = []
    for k, part in enumerate(synth.parse_shape(shape)):
        if len(part) == 3:
            alphabet, least, most = part
            n = str(least) if least == most else f"({draw(key, q(f'{slot}.{k}.n'), most - least + 1)} + {least})"
            step = draw(key, q(f"{slot}.{k}.") + " || CAST(j AS VARCHAR)", len(alphabet))
            parts.append(f"array_to_string(list_transform(range(1, {n} + 1), lambda j: substr({q(alphabet)}, {step} + 1, 1)), '')")
        elif isinstance(part[0], list):
            parts.append(f"list_extract([{', '.join(map(q, part[0]))}], {draw(key, q(f'{slot}.{k}'), len(part[0]))} + 1)")
        else:
            parts.append(_text(part[0]))
    return "(" + " || ".join(parts) + ")"


def _text(s: str) -> str:
    return " || chr(10) || ".join(q(x) for x in s.split("\n"))


def card(key: str, slot: str = "card") -> str:
    body = f"('4' || {shape_value('{D:14}', key, slot)})"
    total = f"list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * CAST(substr(b, i, 1) AS INT) > 9 THEN 2 * CAST(substr(b, i, 1) AS INT) - 9 ELSE 2 * CAST(substr(b, i, 1) AS INT) END ELSE CAST(substr(b, i, 1) AS INT) END))"
    sep = f"list_extract(['', '-', ' '], {draw(key, q(slot + '.sep'), 3)} + 1)"
    return f"(SELECT substr(f, 1, 4) || sep || substr(f, 5, 4) || sep || substr(f, 9, 4) || sep || substr(f, 13, 4) FROM (SELECT b || CAST((10 - {total} % 10) % 10 AS VARCHAR) AS f, {sep} AS sep FROM (SELECT {body} AS b) c0) c1)"


def luhn(digits: str) -> str:
    return f"(regexp_matches({digits}, '^[0-9]{{12,19}}$') AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 1 THEN CASE WHEN 2 * CAST(substr({digits}, i, 1) AS INT) > 9 THEN 2 * CAST(substr({digits}, i, 1) AS INT) - 9 ELSE 2 * CAST(substr({digits}, i, 1) AS INT) END ELSE CAST(substr({digits}, i, 1) AS INT) END)) % 10 = 0)"


def masked_value(v: str) -> str:
    return f"CASE WHEN length({v}) <= 6 THEN repeat('•', length({v})) WHEN length({v}) <= 14 THEN left({v}, 2) || repeat('•', length({v}) - 4) || right({v}, 2) ELSE left({v}, 6) || repeat('•', 6) || right({v}, 4) END"


def pretty(label: str) -> str:
    return "CASE " + " ".join(f"WHEN {label} = {q(k)} THEN {q(v)}" for k, v in text.PRETTY.items()) + f" ELSE replace(lower({label}), '_', ' ') END"


_SHAPE = f"regexp_replace(regexp_replace(regexp_replace(text, {q(_MARK)}, '[X]', 'g'), '[0-9]+', 'N', 'g'), '[a-f0-9]{{7,}}', 'H', 'g')"
#: Words of the clean texts with their BIO tags.
WORDS = f"""words AS ({find_all('clean', chr(92) + 'S+')}),
bio AS (SELECT w.id, w.i, w.value AS word,
 coalesce((SELECT min_by(CASE WHEN e.start = w.start THEN 'B-' ELSE 'I-' END || e.label, e.i) FROM ents e WHERE e.id = w.id AND e.start <= w.start AND w.start < e."end"),
 (SELECT min_by(CASE WHEN e.start = w.start + (w."end" - w.start) // 2 THEN 'B-' ELSE 'I-' END || e.label, e.i) FROM ents e WHERE e.id = w.id AND e.start <= w.start + (w."end" - w.start) // 2 AND w.start + (w."end" - w.start) // 2 < e."end"), 'O') AS tag FROM words w)"""
_LABELS = "sets AS (SELECT a.id, a.split, coalesce((SELECT list_sort(list(DISTINCT label)) FROM ents e WHERE e.id = a.id), []) AS labels FROM annotated a)"
_STRATA = "strata AS (SELECT id, category, CASE WHEN length(text) < 80 THEN 'short' WHEN length(text) < 150 THEN 'medium' ELSE 'long' END AS length_mode, id % 3 AS context FROM annotated)"
_ORDER = "md5('42:' || CAST(id AS VARCHAR))"
_IDS = "CASE tag " + " ".join(f"WHEN {q(t)} THEN {k}" for k, t in enumerate(rules.BIO)) + " END"
PIECE_WINDOWS = f"""{BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {WORDS}, named AS (SELECT id, i AS wi, word AS w, {_IDS} AS tag_id FROM bio),
{word_pieces_cte("SELECT id, wi * 100000 + i AS i, wi - 1 AS word, start AS shift, value FROM (" + place_all('named', pieces.RUN, 'id, wi', 'w') + ") z", 'id')},
told AS (SELECT p.*, p.id_ AS piece_id, n.tag_id, lag(p.word) OVER (PARTITION BY p.id ORDER BY pos) AS before FROM (SELECT id, pos, piece, word, start, "end", id_ FROM pieces) p JOIN named n ON n.id = p.id AND n.wi = p.word + 1),
begun AS (SELECT id, unnest(CASE WHEN n <= 126 THEN [0] ELSE range(0, n - 32, 94) END) AS begins FROM (SELECT id, count(*) AS n FROM pieces GROUP BY id) c),
labelled AS (SELECT t.id, b.begins, t.pos, t.piece_id, t.start, t."end", CASE WHEN pos = begins OR before IS DISTINCT FROM word THEN tag_id WHEN tag_id > 0 AND tag_id % 2 = 1 THEN tag_id + 1 ELSE tag_id END AS label FROM told t JOIN begun b ON b.id = t.id AND t.pos >= b.begins AND t.pos < b.begins + 126)"""
_SHIFTED = f"""ner AS (SELECT id, start + CAST(id % 4 AS INT) AS start, CAST(greatest("end", start + id % 4 + 1) AS INT) AS "end", label, i, ((id * 37) % 60 + 40) / 100.0 AS score FROM ents),
tagged AS (SELECT n.id, n.i, n.start, n."end", n.label, substr(c.text, n.start + 1, n."end" - n.start) AS value, 'ner' AS source, {tier_case('n.label')} AS tier, CAST(n.score AS DOUBLE) AS score FROM ner n JOIN clean c USING (id)),
hit AS ({hits('clean')})"""
_FREE = "NOT EXISTS (SELECT 1 FROM ner n WHERE n.id = hit.id AND n.start < hit.\"end\" AND hit.start < n.\"end\")"
_PREDICTED = """predicted AS (SELECT id, CAST(greatest(start + (id % 7 - 3), 0) AS INT) AS start, CAST("end" + (id % 7 - 3) AS INT) AS "end", CASE WHEN id % 11 = 0 THEN 'EMAIL' ELSE label END AS label FROM ents WHERE (id + start) % 7 <> 0
 UNION ALL SELECT id, 100000, 100005, 'SSN' FROM annotated WHERE id % 13 = 0)"""


#: For each expected entity in turn the first prediction that overlaps it and is still free. Predictions keep the order
#: of the entities they come from; the extra one comes last.
_MATCHED = """pr AS (SELECT p.*, row_number() OVER (PARTITION BY p.id ORDER BY p.place) AS j FROM (SELECT id, i AS place, CAST(greatest(start + (id % 7 - 3), 0) AS INT) AS start, CAST("end" + (id % 7 - 3) AS INT) AS "end", CASE WHEN id % 11 = 0 THEN 'EMAIL' ELSE label END AS label FROM ents WHERE (id + start) % 7 <> 0
 UNION ALL SELECT id, 1000000, 100000, 100005, 'SSN' FROM annotated WHERE id % 13 = 0) p),
ex AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM ents),
can AS (SELECT e.id, e.k, list(p.j ORDER BY p.j) AS js FROM ex e JOIN pr p ON p.id = e.id AND p."end" > e.start AND e."end" > p.start GROUP BY e.id, e.k),
lists AS (SELECT e.id, e.k, coalesce(js, []) AS js FROM ex e LEFT JOIN can USING (id, k)),
walk AS (SELECT id, k, js[1] AS j, CASE WHEN len(js) > 0 THEN [js[1]] ELSE [] END AS used FROM lists WHERE k = 1
 UNION ALL SELECT l.id, l.k, list_filter(l.js, lambda x: NOT list_contains(w.used, x))[1], list_concat(w.used, list_filter(l.js, lambda x: NOT list_contains(w.used, x))[1:1]) FROM walk w JOIN lists l ON l.id = w.id AND l.k = w.k + 1),
pairs AS (SELECT w.id, w.k, e.label = p.label AS same, abs(p.start - e.start) <= 2 AND abs(p."end" - e."end") <= 2 AS tight FROM walk w JOIN ex e ON e.id = w.id AND e.k = w.k JOIN pr p ON p.id = w.id AND p.j = w.j WHERE w.j IS NOT NULL)"""
_EXTERNAL = "WHEN 'CREDENTIAL' THEN 'CREDENTIAL' WHEN 'EMAIL' THEN 'EMAIL' WHEN 'PHONE' THEN 'PHONE' WHEN 'SSN' THEN 'SSN'"


def _scorecard(name: str, condition: str) -> str:
    per = lambda table, what="count(*)": f"coalesce((SELECT {what} FROM {table} z WHERE z.id = a.id), 0)"
    return f"""{name}_rows AS (SELECT a.id, a.category, {per('ex')} AS e, {per('pr')} AS p, {per('pairs')} AS d, {per('pairs', 'count(*) FILTER (WHERE same)')} AS c, {per('pairs', 'count(*) FILTER (WHERE tight)')} AS t FROM annotated a WHERE {condition}),
{name} AS (SELECT category, count(*) AS total, CAST(sum(e) AS BIGINT) AS n_expected, CAST(sum(p) AS BIGINT) AS n_predicted, CAST(sum(d) AS BIGINT) AS detected, CAST(sum(c) AS BIGINT) AS correct_label, CAST(sum(t) AS BIGINT) AS tight_boundary, CAST(sum(p - d) AS BIGINT) AS false_positives, round(CASE WHEN sum(e) > 0 THEN sum(d) * 100.0 / sum(e) ELSE 0 END, 6) AS detect_pct FROM {name}_rows GROUP BY category)"""


def _aggregated() -> str:
    """Word pieces placed by a moving cursor, grouped, trimmed, cut at connector words and trimmed again."""
    joint = q(detect.CONNECTOR)
    head, tail = q("^" + detect.EDGES + "+"), q(detect.EDGES + "+$")
    trimmed = lambda inner, start, end: f"least({start} + length({inner}) - length(regexp_replace({inner}, {head}, '')), {end})"
    shut = lambda inner, start, end: f"greatest({end} - (length({inner}) - length(regexp_replace({inner}, {tail}, ''))), {trimmed(inner, start, end)})"
    length = lambda x, a, b: f"coalesce(list_sum(list_transform({x}[{a}:{b}], lambda v: length(v))), 0)"
    return f"""WITH RECURSIVE {BASE[5:]}, {WORDS}, w0 AS (SELECT id, i - 1 AS i, lower(word) AS w, tag, ((id * 31 + (i - 1) * 17) % 70 + 30) / CAST(100 AS DOUBLE) AS score FROM bio),
 tok AS (SELECT id, 2 * i AS o, left(w, 4) AS needle, false AS glued, tag, score FROM w0 UNION ALL SELECT id, 2 * i + 1, substr(w, 5), true, replace(tag, 'B-', 'I-'), score FROM w0 WHERE length(w) > 4),
 seq AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS n FROM tok),
 low AS (SELECT id, lower(text) AS text FROM clean),
 walk AS (SELECT id, CAST(0 AS BIGINT) AS n, 0 AS cursor, CAST(NULL AS INT) AS start, CAST(NULL AS INT) AS stop, '' AS tag, CAST(0 AS DOUBLE) AS score FROM low
  UNION ALL SELECT id, n, CAST(CASE WHEN use THEN spot - 1 + length(needle) ELSE cursor END AS INT), CAST(CASE WHEN use THEN spot - 1 END AS INT), CAST(CASE WHEN use THEN spot - 1 + length(needle) END AS INT), tag, score FROM (
   SELECT *, spot > 0 AND length(needle) > 0 AND (NOT glued OR spot - 1 - cursor < 8) AND tag <> 'O' AND score >= {rules.TOKEN_FLOOR} AS use FROM (
    SELECT s.id, s.n, s.needle, s.glued, s.tag, s.score, w.cursor, CASE WHEN instr(substr(l.text, w.cursor + 1), s.needle) > 0 THEN w.cursor + instr(substr(l.text, w.cursor + 1), s.needle) ELSE 0 END AS spot
    FROM walk w JOIN seq s ON s.id = w.id AND s.n = w.n + 1 JOIN low l ON l.id = w.id) y) z),
 placed AS (SELECT id, n, start, stop, left(tag, 1) AS prefix, substr(tag, 3) AS label, score FROM walk WHERE start IS NOT NULL),
 marked AS (SELECT *, CASE WHEN prefix = 'I' AND label = lag(label) OVER (PARTITION BY id ORDER BY n) THEN 0 ELSE 1 END AS opens FROM placed),
 isles AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY n) AS g FROM marked),
 groups_ AS (SELECT id, g, arg_min(start, n) AS start, arg_max(stop, n) AS stop, min(label) AS label, avg(score) AS score FROM isles GROUP BY id, g),
 inner_ AS (SELECT x.*, substr(text, start + 1, stop - start) AS inner_text FROM groups_ x JOIN clean USING (id)),
 cut AS (SELECT id, g, label, score, {trimmed('inner_text', 'start', 'stop')} AS start, {shut('inner_text', 'start', 'stop')} AS stop FROM inner_),
 again AS (SELECT c.*, substr(text, start + 1, stop - start) AS inner_text FROM cut c JOIN clean USING (id)),
 split_ AS (SELECT *, regexp_split_to_array(inner_text, {joint}) AS gaps, regexp_extract_all(inner_text, {joint}) AS hits FROM again),
 pieces AS (SELECT id, label, score, start + {length('gaps', 1, 'k - 1')} + {length('hits', 1, 'k - 1')} AS start, start + {length('gaps', 1, 'k')} + {length('hits', 1, 'k - 1')} AS stop, gaps[k] AS piece FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS k FROM split_) u),
 done AS (SELECT id, label, score, {trimmed('piece', 'start', 'stop')} AS start, {shut('piece', 'start', 'stop')} AS stop FROM pieces)
 SELECT id, CAST(start AS INT) AS start, CAST(stop AS INT) AS "end", label, round(score, 9) AS score FROM done WHERE stop > start"""


def _contract(col: str) -> str:
    col = f"lower({col})"
    for long, short in rules.CONTRACTIONS:
        col = f"replace({col}, {q(long)}, {q(short)})"
    return col


def _escape(col: str) -> str:
    for raw, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        col = f"replace({col}, {q(raw)}, {q(put)})"
    return col


def _variable(value: str, label: str, key: str, slot: str = "'var'") -> str:
    pick = lambda names: f"list_extract([{', '.join(map(q, names))}], {draw(key, slot, len(names))} + 1)"
    out = ""
    for r in synth.variable_rules():
        tests = [f"{label} = 'CREDENTIAL'", *[f"{fn}({value}, {q(r[k])})" for k, fn in (("head", "starts_with"), ("tail", "ends_with"), ("inside", "contains")) if r[k]]]
        if r["least"] or r["most"] < 1 << 30:
            tests.append(f"length({value}) BETWEEN {r['least']} AND {r['most']}")
        out += f" WHEN {' AND '.join(tests)} THEN {pick(r['names'])}"
    out += "".join(f" WHEN {label} = {q(k)} THEN {pick(n)}" for k, n in synth.LABEL_VARIABLES.items())
    return f"CASE{out} ELSE 'VALUE' END"


def _between_markers(text: str, change) -> str:
    return f"array_to_string(list_transform(list_zip(list_transform(regexp_split_to_array({text}, {q(_MARK)}), lambda g: {change('g')}), regexp_extract_all({text}, {q(_MARK)})), lambda z: z[1] || coalesce(z[2], '')), '')"


def voiced(text: str, key: str) -> str:
    """One of the voices by weight, for a column."""
    def terse(g: str) -> str:
        words = f"list_transform(string_split({g}, ' '), lambda w, i: {{'w': w, 'gone': lower(w) = 'the' AND {draw(key, chr(39) + 'the.' + chr(39) + ' || CAST(i - 1 AS VARCHAR)', 10)} < 4}})"
        out = f"array_to_string(list_transform(list_filter({words}, lambda x: NOT x.gone), lambda x: x.w), ' ')"
        for k, (long, short) in enumerate(synth.ABBREVIATIONS):
            out = f"CASE WHEN {draw(key, q(f'abbr.{k}'), 2)} = 1 THEN replace({out}, {q(long)}, {q(short)}) ELSE {out} END" if k == 0 else f"list_transform([{out}], lambda t{k}: CASE WHEN {draw(key, q(f'abbr.{k}'), 2)} = 1 THEN replace(t{k}, {q(long)}, {q(short)}) ELSE t{k} END)[1]"
        return out

    alarm = " ".join(f"WHEN contains(lower(g), {q(w)}) THEN replace(g, {q(w)}, {q(w.upper())})" for w in synth.ALARMS)
    loud = _between_markers(text, lambda g: f"CASE WHEN {draw(key, q('alarm'), 2)} = 1 THEN CASE {alarm} ELSE g END ELSE g END")
    mark = draw(key, q("mark"), 10)
    panicked = f"list_transform([{loud}], lambda p: CASE WHEN ends_with(p, '?') AND {mark} < 4 THEN left(p, length(p) - 1) || '??' WHEN ends_with(p, '.') AND {mark} < 3 THEN left(p, length(p) - 1) || '!!' ELSE p END)[1]"
    calm = f"list_transform([{_between_markers(text, _contract)}], lambda p: CASE WHEN ends_with(p, '.') AND {draw(key, q('dot'), 10)} < 3 THEN left(p, length(p) - 1) ELSE p END)[1]"
    return f"CASE {weighted(uniform(key, 'voice'), synth.VOICES)} WHEN 'casual' THEN {calm} WHEN 'terse' THEN {_between_markers(text, terse)} WHEN 'panicked' THEN {panicked} ELSE {text} END"


def statements() -> dict[str, str]:
    cols = "id, start, \"end\", label, value, source, tier, score"
    audit_sets = {k: q(p) for k, p in rules.AUDIT_FORMATS.items()}
    line = r"(?m)^([A-Z][A-Z_0-9]+)=" + _MARK
    var_rules = [(v, "starts_with", p, None) for v, ps in rules.VARIABLE_PREFIXES.items() for p in ps] + [(v, "len_eq", "", n) for v, n in rules.VARIABLE_LENGTHS.items()]
    shapes = " UNION ALL ".join(f"SELECT n_nationkey, {q(n)} AS shape, {shape_value(s, 'n_nationkey', n)} AS value FROM nation" for n, s in synth.SHAPES.items())
    stop = r"\b(?:" + "|".join(rules.STOP_WORDS) + r")\b"
    customers = "SELECT c_custkey AS id FROM customer"
    positives, negatives = synth_sql.positives(customers, voiced, _variable, weighted), synth_sql.negatives(customers, weighted)
    ranked = "ranked AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) <= floor(count(*) OVER () * 0.3) AS neg FROM customer)"
    of = lambda keep: f"SELECT id FROM ranked WHERE {keep}"
    top = lambda f, t: f"CASE WHEN {t} THEN {f} ELSE 0 END"
    out = {
        "detect_regex_spans": f"{BASE} SELECT {cols} FROM ({hits('every')}) h",
        "detect_and_mask": f"{BASE}, hit AS ({hits('every')}) SELECT id, md5({block_masked('text')}) AS masked_md5, (SELECT count(*) FROM hit h WHERE h.id = e.id) AS n_spans FROM every e",
        "mask_documents": f"WITH hit AS ({hits('documents', 'doc_id')}) SELECT doc_id, length({block_masked('text')}) AS masked_len, (SELECT count(*) FROM hit h WHERE h.doc_id = d.doc_id) AS n_spans FROM documents d",
        "scan_conversations": f"WITH c AS (SELECT conv_id * 100000 + turn AS id, conv_id, text FROM conversations), hit AS ({hits('c')}) SELECT conv_id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_spans, count(*) AS turns FROM c LEFT JOIN (SELECT id, count(*) AS n FROM hit GROUP BY id) x USING (id) GROUP BY conv_id",
        "merge_tagged_and_hits": f"{BASE}, {_SHIFTED} SELECT {cols} FROM tagged UNION ALL SELECT {cols} FROM hit WHERE {_FREE}",
        "anti_interval_join": f"{BASE}, {_SHIFTED} SELECT id AS doc_id, start, \"end\", source FROM hit WHERE {_FREE}",
        "postprocess_spans": f"""{BASE}, s0 AS (SELECT id, start, "end", CASE WHEN id % 5 = 0 THEN 'PHONE' ELSE label END AS label, value, CAST(((id * 37) % 60 + 40) / 100.0 AS DOUBLE) AS score, trim(value) AS v, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM ents),
 s1 AS (SELECT *, regexp_matches(v, {q(rules.STRICT_SSN)}) AS ssn, regexp_matches(v, {q(rules.STRICT_CARD)}) AND {luhn('d')} AS card FROM s0 WHERE score >= 0.85),
 s2 AS (SELECT id, start, "end", CASE WHEN ssn THEN 'SSN' WHEN card THEN 'CREDIT_CARD' ELSE label END AS label, value, CASE WHEN ssn THEN 'ner+format-override' WHEN card THEN 'ner+luhn-override' ELSE 'ner' END AS source, score, v, d, ssn, card FROM s1)
 SELECT id, start, "end", label, value, source, 'block' AS tier, score FROM s2 WHERE CASE label WHEN 'SSN' THEN ssn OR length(d) = 9 WHEN 'CREDIT_CARD' THEN card WHEN 'PHONE' THEN regexp_matches(v, {q(rules.PHONE_LIKE)}) OR length(d) BETWEEN 10 AND 15 ELSE true END""",
        "tier_override": f"{BASE}, hit AS ({hits('every')}) SELECT id, count(*) FILTER (WHERE label = 'IP_ADDRESS') AS n_block, count(*) FILTER (WHERE label IS NOT NULL AND label <> 'IP_ADDRESS') AS n_warn FROM every LEFT JOIN hit USING (id) GROUP BY id",
        "parse_entities": f"{BASE} SELECT id, start, \"end\", label, value FROM ents",
        "parse_markers": f"{BASE} SELECT id, i - 1 AS pos, start, \"end\", value, label FROM marks",
        "strip_markers": f"WITH {ANNOTATED_CTE} SELECT id, md5({_STRIP}) AS clean_md5, md5(regexp_replace(text, {q(rules.MARKER_V1)}, '\\1', 'g')) AS v1_md5 FROM annotated",
        "bio_words": f"{BASE}, {WORDS} SELECT id, i - 1 AS pos, word, tag FROM bio",
        "shape_hashes": f"WITH {ANNOTATED_CTE} SELECT id, md5({_SHAPE}) AS shape FROM annotated UNION ALL SELECT -doc_id - 1, md5({_SHAPE}) FROM documents",
        "replace_entities": f"WITH {ANNOTATED_CTE} SELECT id, {'regexp_replace(' * 2}text, '\\[([^\\]\\|]*)\\|({'|'.join(rules.LABELS)})\\]', {q(rules.MASK_HEAD + chr(92) + '2' + rules.MASK_TAIL)}, 'g'), {q(_MARK)}, '\\1', 'g') AS replaced FROM annotated",
        "mask_and_name_values": f"{BASE} SELECT id, i - 1 AS pos, {masked_value('trim(value)')} AS masked, {pretty('label')} AS name FROM marks",
        "escape_pages": f"SELECT page_id, md5({_escape('html')}) AS escaped_md5 FROM pages",
        "chunk_documents": f"SELECT doc_id, pos, md5(CASE WHEN length(text) <= {rules.CHUNK} THEN text ELSE substr(text, pos + 1, {rules.CHUNK}) END) AS chunk_md5 FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= {rules.CHUNK} THEN [0] ELSE range(0, length(text), {rules.CHUNK_STEP}) END) AS pos FROM documents) c",
        "token_windows": "SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(least(510, n - start) AS BIGINT) AS n_tokens, CAST(least(510, n - start) + 2 AS BIGINT) AS n_labels FROM (SELECT doc_id, n, unnest(CASE WHEN n <= 510 THEN [0] ELSE range(0, n - 128, 382) END) AS start FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents) d WHERE n > 0) w",
        "contract_outside_markers": f"WITH {ANNOTATED_CTE} SELECT id, array_to_string(list_transform(list_zip(list_transform(regexp_split_to_array(text, {q(_MARK)}), lambda g: {_contract('g')}), regexp_extract_all(text, {q(_MARK)})), lambda z: z[1] || coalesce(z[2], '')), '') AS text FROM annotated",
        "split_tags": f"{BASE}, {WORDS} SELECT CASE WHEN tag = 'O' THEN 'I' ELSE left(tag, 1) END AS prefix, CASE WHEN tag = 'O' THEN 'O' ELSE substr(tag, 3) END AS label, count(*) AS n FROM bio GROUP BY ALL",
        "luhn_numbers": f"SELECT o_orderkey, {luhn('x')} AS valid FROM (SELECT o_orderkey, '4111' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS x FROM orders) o",
        "interface_scalars": "SELECT n_nationkey, CASE WHEN n_nationkey <= 1 THEN 8000 WHEN n_nationkey <= 3 THEN 12000 WHEN n_nationkey <= 9 THEN 18000 ELSE 0 END AS dismiss_ms, least(120, greatest(1, CASE WHEN n_nationkey = 0 THEN 5 ELSE n_nationkey * 7 END)) AS minutes FROM nation",
        "audit_structural": f"{BASE}, c AS (SELECT a.split = 'neg' AS neg, (SELECT count(*) FROM marks m WHERE m.id = a.id) AS n, (SELECT count(*) FROM marks m WHERE m.id = a.id AND m.value = '') AS e, (SELECT count(*) FROM marks m WHERE m.id = a.id AND m.label NOT IN ({_KNOWN})) AS u, regexp_matches(regexp_replace(text, {q(_MARK)}, '', 'g'), '\\|(CREDENTIAL|EMAIL|SSN)\\]') AS loose FROM annotated a) SELECT CAST(sum(e) AS BIGINT) AS empty_value, CAST(sum(u) AS BIGINT) AS unknown_label, CAST({top('count(*) FILTER (WHERE n = 0)', 'NOT neg')} AS BIGINT) AS positive_without_marker, CAST({top('count(*) FILTER (WHERE n > 0)', 'neg')} AS BIGINT) AS negative_with_marker, count(*) FILTER (WHERE loose) AS unparsed_marker FROM c GROUP BY neg",
        "audit_semantic": f"{BASE} SELECT count(*) FILTER (WHERE label = 'CREDENTIAL' AND regexp_matches(value, {audit_sets['SSN']})) AS cred_looks_like_ssn, count(*) FILTER (WHERE label = 'CREDENTIAL' AND regexp_matches(value, '^[0-9\\s\\-]{{15,19}}$')) AS cred_looks_like_cc, count(*) FILTER (WHERE label = 'CREDENTIAL' AND regexp_matches(value, {audit_sets['EMAIL']})) AS cred_looks_like_email, " + ", ".join(f"count(*) FILTER (WHERE label = {q(k)} AND NOT regexp_matches(value, {p})) AS {k.lower()}_bad_format" for k, p in audit_sets.items()) + " FROM marks",
        "audit_variable_mismatches": f"WITH {ANNOTATED_CTE}, v AS (SELECT id, i, g1 AS var, g2 AS value FROM ({find_all('annotated', line, groups=(1, 2))}) x), r AS (SELECT * FROM {values(var_rules, 'var, kind, prefix, n')}) SELECT id, var, value FROM (SELECT v.id, v.i, v.var, v.value, bool_or(CASE WHEN kind = 'len_eq' THEN length(value) = n ELSE starts_with(value, prefix) END) AS ok FROM v JOIN r USING (var) GROUP BY ALL) y WHERE NOT ok",
        "audit_diversity": f"WITH {ANNOTATED_CTE}, l AS (SELECT list_sort(list(length(text))) AS s, count(*) AS n FROM annotated) SELECT (SELECT count(*) FROM annotated) AS rows, count(DISTINCT md5({_SHAPE})) AS unique_shapes, count(DISTINCT md5({_SHAPE})) * 100.0 / count(*) AS diversity_pct, CAST((SELECT s[CASE WHEN n > 100 THEN CAST(floor(n * 0.01) AS INT) + 1 ELSE 1 END] FROM l) AS INT) AS p1, CAST((SELECT s[n // 2 + 1] FROM l) AS INT) AS p50, CAST((SELECT s[CASE WHEN n > 100 THEN CAST(floor(n * 0.99) AS INT) + 1 ELSE n END] FROM l) AS INT) AS p99 FROM annotated",
        "audit_top_repeats": f"WITH {ANNOTATED_CTE} SELECT md5({_SHAPE}) AS shape, count(*) AS n FROM annotated GROUP BY 1 ORDER BY n DESC, shape LIMIT 5",
        "audit_coverage": f"{BASE}, x AS (SELECT * FROM {values(list(rules.EXPECTED_SHARE.items()), 'label, expected')}), t AS (SELECT count(*) AS total FROM marks) SELECT label, n, round(n * 100.0 / total, 6) AS actual_pct, CAST(expected AS DOUBLE) AS expected_pct, round((n * 100.0 / total - expected) / expected * 100, 6) AS deviation_pct, abs((n * 100.0 / total - expected) / expected * 100) <= 20 AS within_tolerance FROM (SELECT x.label, x.expected, count(m.id) AS n FROM x LEFT JOIN marks m USING (label) GROUP BY ALL) y, t",
        "audit_word_leaks": f"{BASE} SELECT id, value FROM marks WHERE label = 'CREDENTIAL' AND regexp_matches(lower(value), {q(stop)})",
        "audit_adjacent_labels": f"{BASE} SELECT id, i - 1 AS pos, label FROM (SELECT *, lead(start) OVER w AS s2, lead(label) OVER w AS l2 FROM marks WINDOW w AS (PARTITION BY id ORDER BY start)) x WHERE label = l2 AND s2 - \"end\" <= 5",
        "audit_cross_split": f"WITH {ANNOTATED_CTE}, s AS (SELECT DISTINCT split, text FROM annotated) SELECT 'internal:' || split AS check, count(*) - count(DISTINCT text) AS n FROM annotated GROUP BY split UNION ALL SELECT a.split || '&' || b.split, count(*) FROM s a JOIN s b ON a.text = b.text AND a.split < b.split GROUP BY 1",
        "audit_prefix_overlap": f"{BASE}, p AS (SELECT left(value, 6) AS prefix FROM marks m JOIN annotated a USING (id) WHERE a.split <> 'neg' AND label = 'CREDENTIAL' AND length(value) >= 6 GROUP BY 1 HAVING count(*) >= 5) SELECT DISTINCT a.id FROM annotated a, p WHERE a.split = 'neg' AND (" + " OR ".join(f"contains(a.text, {c} || prefix)" for c in ("' '", "'='", "':'", "'\"'", "''''", "chr(10)")) + ")",
        "audit_first_examples": f"{BASE} SELECT id FROM annotated WHERE id NOT IN (SELECT id FROM marks) ORDER BY id LIMIT 5",
        "audit_token_sample": f"{DOCUMENT_PIECES}, x AS (SELECT d.doc_id, count(p.pos) AS n FROM documents d LEFT JOIN pieces p USING (doc_id) GROUP BY d.doc_id ORDER BY md5('42:' || CAST(d.doc_id AS VARCHAR)), d.doc_id LIMIT 100), y AS (SELECT list_sort(list(n)) AS s, count(*) AS c FROM x) SELECT c AS sampled, CAST(s[c // 100 + 1] AS INT) AS p1, CAST(s[c // 2 + 1] AS INT) AS p50, CAST(s[CAST(least(c - 1, floor(c * 0.99)) AS INT) + 1] AS INT) AS p99, (SELECT count(*) FROM x WHERE n > 512) AS over_limit, CAST((SELECT max(n) FROM x) AS INT) AS max FROM y",
        "failed_detection": f"""SELECT doc_id, CASE WHEN bad THEN 'RuntimeError: seven' ELSE '' END AS error, md5(CASE WHEN bad THEN text ELSE masked END) AS open_md5, md5(CASE WHEN bad THEN 'held' ELSE masked END) AS held_md5, md5(masked) AS patterns_md5
 FROM (SELECT doc_id, text, length(text) % 7 = 0 AS bad, {block_masked('text')} AS masked FROM documents WHERE length(text) <= {rules.CHUNK}) d""",
        "document_pieces": f"""{DOCUMENT_PIECES} SELECT d.doc_id, count(p.pos) AS n_pieces, count(*) FILTER (p.id_ = 1) AS n_unknown, md5(coalesce(string_agg(p.piece || ':' || p.id_ || ':' || p.word || ':' || p.start || ':' || p."end", ' ' ORDER BY p.pos), '')) AS pieces_md5 FROM documents d LEFT JOIN pieces p USING (doc_id) GROUP BY d.doc_id""",
        "piece_windows": f"""{PIECE_WINDOWS} SELECT id, CAST(begins AS BIGINT) AS start, count(*) + 2 AS n_ids, md5('2 ' || string_agg(CAST(piece_id AS VARCHAR), ' ' ORDER BY pos) || ' 3') AS ids_md5, md5('-100 ' || string_agg(CAST(label AS VARCHAR), ' ' ORDER BY pos) || ' -100') AS labels_md5,
 md5(' ' || string_agg(start || ':' || "end", ' ' ORDER BY pos) || ' ') AS offsets_md5 FROM labelled GROUP BY id, begins""",
        "benchmark_overlap": "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM benchmark)",
        "audit_diversity_sketches": f"WITH {ANNOTATED_CTE} SELECT coalesce(split, 'all') AS split, count(*) AS rows, count(DISTINCT {_SHAPE}) AS unique_shapes, true AS estimate_is_near FROM annotated GROUP BY GROUPING SETS ((split), ())",
        "audit_cube": f"WITH {ANNOTATED_CTE}, {MARKERS} SELECT a.split, a.category, m.label, CAST(grouping_id(a.split, a.category, m.label) AS BIGINT) AS level, count(*) AS n FROM annotated a JOIN marks m USING (id) GROUP BY CUBE (a.split, a.category, m.label)",
        "benchmark_passages": """WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM benchmark),
 dp AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 7], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8) x), ip AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 7], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS k FROM i WHERE len(w) >= 8) y)
 SELECT doc_id, item_id, count(*) AS shared, max(n) AS passages FROM dp JOIN ip USING (p) JOIN (SELECT item_id, count(*) AS n FROM ip GROUP BY item_id) z USING (item_id) GROUP BY doc_id, item_id""",
        "stratified_split": f"WITH {ANNOTATED_CTE}, {_STRATA} SELECT id, CASE WHEN k <= CASE WHEN n >= 10 THEN greatest(1, floor(n * 0.1)) ELSE 0 END THEN 'eval' ELSE 'train' END AS split FROM (SELECT id, count(*) OVER (PARTITION BY context, length_mode, category) AS n, row_number() OVER (PARTITION BY context, length_mode, category ORDER BY {_ORDER}, id) AS k FROM strata) x",
        "bucket_counts": f"WITH {ANNOTATED_CTE}, {_STRATA} SELECT context, length_mode, category, count(*) AS n FROM strata GROUP BY ALL",
        "uncovered_buckets": f"WITH {ANNOTATED_CTE}, {_STRATA} SELECT context, length_mode, category, count(*) FILTER (WHERE id % 97 <> 0) AS n FROM strata GROUP BY context, length_mode, category HAVING n >= 10 AND count(*) FILTER (WHERE id % 97 = 0) = 0",
        "rarest_label_split": f"{BASE}, {_LABELS}, f AS (SELECT label, count(*) AS f FROM (SELECT unnest(labels) AS label FROM sets) u GROUP BY label), b AS (SELECT s.id, coalesce((SELECT l FROM (SELECT f.f, f.label AS l FROM f WHERE list_contains(s.labels, f.label) ORDER BY f.f, f.label LIMIT 1) z), 'O') AS bucket FROM sets s) SELECT id, bucket, CASE WHEN row_number() OVER (PARTITION BY bucket ORDER BY {_ORDER}, id) <= greatest(1, count(*) OVER (PARTITION BY bucket) // 10) THEN 'eval' ELSE 'train' END AS split FROM b",
        "label_frequency": f"{BASE}, {_LABELS} SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM sets) u GROUP BY label",
        "eval_share": f"{BASE}, {_LABELS} SELECT label, count(*) AS total, count(*) FILTER (WHERE split = 'eval') AS in_eval, round(count(*) FILTER (WHERE split = 'eval') * 100.0 / count(*), 6) AS eval_pct, NOT (count(*) FILTER (WHERE split = 'eval') * 100.0 / count(*) BETWEEN 7 AND 13) AS flag FROM (SELECT split, unnest(labels) AS label FROM sets) u GROUP BY label",
        "dense_ids": "SELECT row_number() OVER (ORDER BY c_name) AS id, c_name FROM customer",
        "keyed_sample": "SELECT doc_id AS id FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 12",
        "sample_each_source": "SELECT id, source FROM (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) x WHERE k <= 2",
        "weighted_labels": f"SELECT c_custkey, {weighted(uniform('c_custkey', 'label'), synth.LABEL_WEIGHTS)} AS label FROM customer",
        "language_filter": "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source",
        "combined_corpus": f"WITH {ANNOTATED_CTE} SELECT split, count(*) AS n, count(DISTINCT text) AS n_texts FROM (SELECT split, text FROM annotated UNION ALL SELECT 'documents', text FROM documents) x GROUP BY split",
        "entity_f1": f"""{BASE}, {_PREDICTED}, e AS (SELECT DISTINCT id, label, start, "end" FROM ents), p AS (SELECT DISTINCT id, label, start, "end" FROM predicted),
 c AS (SELECT label, count(*) AS x, 0 AS y, 0 AS z FROM e GROUP BY label UNION ALL SELECT label, 0, count(*), 0 FROM p GROUP BY label UNION ALL SELECT label, 0, 0, count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM p) i GROUP BY label),
 s AS (SELECT label, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM c GROUP BY label UNION ALL SELECT 'micro', sum(x), sum(y), sum(z) FROM c)
 SELECT label, CAST(x AS BIGINT) AS expected, CAST(y AS BIGINT) AS predicted, CAST(z AS BIGINT) AS correct, round(CASE WHEN y > 0 THEN z / y ELSE 0 END, 9) AS precision, round(CASE WHEN x > 0 THEN z / x ELSE 0 END, 9) AS recall, round(CASE WHEN z > 0 THEN 2 * (z / y) * (z / x) / (z / y + z / x) ELSE 0 END, 9) AS f1 FROM s""",
        "tag_entities": f"{BASE}, {WORDS}, t AS (SELECT id, i, tag, lag(tag) OVER (PARTITION BY id ORDER BY i) AS was FROM bio), g AS (SELECT *, sum(CASE WHEN tag <> 'O' AND (tag LIKE 'B-%' OR was IS NULL OR was = 'O' OR substr(was, 3) <> substr(tag, 3)) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS isle FROM t) SELECT id, min(substr(tag, 3)) AS label, min(i) - 1 AS start, max(i) AS \"end\" FROM g WHERE tag <> 'O' GROUP BY id, isle",
        "class_weights": f"{BASE}, {WORDS}, c AS (SELECT {_IDS} AS label_id, count(*) AS n FROM bio GROUP BY 1) SELECT k AS label_id, round(CASE WHEN n IS NULL THEN 1.0 ELSE least(6.0, (SELECT sum(n) FROM c) / (11.0 * n)) END, 9) AS weight FROM (SELECT unnest(range(0, 11)) AS k) r LEFT JOIN c ON k = label_id",
        "tag_distribution": f"{BASE}, {WORDS}, c AS (SELECT {_IDS} AS tag, count(*) AS n FROM bio GROUP BY 1) SELECT CAST(tag AS BIGINT) AS tag, n, round(n * 100.0 / (SELECT sum(n) FROM c), 6) AS pct FROM c",
        "best_epoch": "SELECT n_nationkey AS epoch FROM nation ORDER BY (n_nationkey * 7) % 11 DESC, n_nationkey LIMIT 1",
        "synth_values": shapes,
        "synth_cards": f"SELECT c_custkey, {card('c_custkey')} AS card, true AS valid FROM customer",
        "synth_negatives": f"WITH {negatives} SELECT * FROM negatives",
        "synth_adversarial": f"WITH {synth_sql.adversarial(customers, shape_value)} SELECT id, kind AS category, text FROM b JOIN texts USING (id)",
        "synth_corpus": f"""WITH {ranked} SELECT id, 'positive' AS split, context AS kind, text FROM (WITH {synth_sql.positives(of('NOT neg'), voiced, _variable, weighted)} SELECT * FROM positives) p
 UNION ALL SELECT id, 'negative', kind, text FROM (WITH {synth_sql.negatives(of('neg'), weighted)} SELECT * FROM negatives) n""",
        "variable_names": f"{BASE} SELECT id, i - 1 AS pos, {_variable('value', 'label', 'id')} AS var FROM marks",
        "site_lookup": f"SELECT page_id, host, site FROM (SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1), '') AS host FROM pages) p LEFT JOIN (SELECT * FROM {values(list(policy.HOSTS.items()), 'h, site')}) s ON p.host = s.h",
        "effective_settings": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'false' ELSE 'true' END AS enabled, CASE WHEN n_nationkey % 2 = 0 THEN 'confirm' ELSE 'modal' END AS \"blockBehavior\", CAST(n_nationkey AS VARCHAR) AS \"cooldownMinutes\", 'banner' AS \"warnBehavior\", '5' AS \"warnAutoDismissSec\" FROM nation",
        "paste_decisions": f"""{BASE}, hit AS ({hits('every')}), h AS (SELECT id, count(*) FILTER (WHERE tier = 'block') AS b, count(*) FILTER (WHERE tier = 'warn') AS w FROM hit GROUP BY id),
 m AS (SELECT *, (id % 4 + 4) % 4 AS how, (id % 5 + 5) % 5 AS quiet, (id % 3 + 3) % 3 AS answer FROM every)
 SELECT id, md5(CASE WHEN coalesce(b, 0) = 0 THEN text WHEN how = 1 OR (how = 2 AND quiet = 0) THEN {block_masked('text')} WHEN answer = 0 THEN {block_masked('text')} WHEN answer = 1 THEN text END) AS inserted_md5, coalesce(w, 0) > 0 AS banner FROM m LEFT JOIN h USING (id)""",
        "finding_chips": f"""{BASE}, hit AS ({ranked_hits('every')}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pattern, start) AS n FROM hit),
 s AS (SELECT id, string_agg({pretty('label')} || ':' || {masked_value('trim(value)')}, '; ' ORDER BY n) FILTER (WHERE n <= 3) AS shown, count(*) AS c FROM r GROUP BY id)
 SELECT id, coalesce(shown, '') AS shown, greatest(coalesce(c, 0) - 3, 0) AS more FROM every LEFT JOIN s USING (id)""",
        "dedupe_spans": f"""WITH RECURSIVE {BASE[5:]}, hit AS ({ranked_hits('every')}),
 both_ AS (SELECT id, pattern, 0 AS copy, start, "end", label, value, source, tier, score FROM hit UNION ALL SELECT id, pattern, 1, start + 1, "end" + 1, label, value, source, tier, score FROM hit),
 o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start, score DESC, copy, pattern) AS n FROM both_),
 w AS (SELECT *, label AS last_label, "end" AS last_end, true AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.*, CASE WHEN w.last_label = o.label AND w.last_end > o.start THEN w.last_label ELSE o.label END, CASE WHEN w.last_label = o.label AND w.last_end > o.start THEN w.last_end ELSE o."end" END, NOT (w.last_label = o.label AND w.last_end > o.start) FROM w JOIN o ON o.id = w.id AND o.n = w.n + 1)
 SELECT {cols} FROM w WHERE kept""",
        "cooldown_sessions": """WITH RECURSIVE e AS (SELECT 'host' || (user_id % 11) AS host, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id % 3 = 0 AS needs FROM events),
 p AS (SELECT host, min(t) AS t FROM e WHERE needs GROUP BY host UNION ALL SELECT p.host, (SELECT min(e.t) FROM e WHERE e.host = p.host AND e.needs AND e.t >= p.t + 300) FROM p WHERE p.t IS NOT NULL),
 c AS (SELECT host, count(t) AS prompts FROM p GROUP BY host)
 SELECT host, count(*) AS n, count(*) FILTER (WHERE needs) - min(coalesce(prompts, 0)) AS silent, min(coalesce(prompts, 0)) AS prompts FROM e LEFT JOIN c USING (host) GROUP BY host""",
        "robustness_scorecard": f"WITH RECURSIVE {BASE[5:]}, {_PREDICTED}, {_MATCHED}, {_scorecard('card', 'true')} SELECT * FROM card",
        "scorecard_regression": f"""WITH RECURSIVE {BASE[5:]}, {_PREDICTED}, {_MATCHED}, {_scorecard('fresh', 'true')}, {_scorecard('old', "id % 2 = 0 AND category <> 'SSN'")}
 SELECT f.category, f.detect_pct AS new_pct, o.detect_pct AS old_pct FROM fresh f LEFT JOIN old o USING (category)""",
        "external_to_bio": f"""{BASE}, x AS (SELECT id, i, start, "end", value, CASE label {_EXTERNAL} END AS label FROM ents), t AS (SELECT * FROM clean WHERE id IN (SELECT id FROM x WHERE label IS NOT NULL)),
 v AS (SELECT x.*, len(regexp_extract_all(value, '\\S+')) AS n, coalesce(max(CASE WHEN value ~ '.*\\S.*' THEN "end" END) OVER (PARTITION BY id ORDER BY start, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM x WHERE label IS NOT NULL),
 parts AS (SELECT v.id, v.start AS a, v.i AS b, 0 AS c, regexp_extract_all(substr(text, pos + 1, greatest(v.start - pos, 0)), '\\S+') AS words, NULL AS label FROM v JOIN t USING (id)
  UNION ALL SELECT id, start, i, 1, regexp_extract_all(value, '\\S+'), label FROM v
  UNION ALL SELECT t.id, 1000000000, 0, 2, regexp_extract_all(substr(text, coalesce((SELECT max("end") FROM v WHERE v.id = t.id AND v.n > 0), 0) + 1), '\\S+'), NULL FROM t),
 flat AS (SELECT id, a, b, c, label, words, unnest(range(1, len(words) + 1)) AS k FROM parts)
 SELECT id, row_number() OVER (PARTITION BY id ORDER BY a, b, c, k) - 1 AS pos, words[k] AS word, CASE WHEN label IS NULL THEN 'O' WHEN k = 1 THEN 'B-' || label ELSE 'I-' || label END AS tag FROM flat""",
        "aggregate_word_pieces": _aggregated(),
        "synth_positives": f"WITH {positives} SELECT * FROM positives",
        "synth_voices": f"WITH {ANNOTATED_CTE} SELECT id, {voiced('text', 'id')} AS text FROM annotated",
    }
    return out
