"""SQL of the synthesis queries: the grammar as tables, read by joins."""

from __future__ import annotations

from ..operators import grammar, synth


def q(s: str | None) -> str:
    """A literal; line ends are written as chr(10) and the like, so that a statement stays on its lines."""
    if s is None:
        return "NULL"
    out = "'" + s.replace("'", "''") + "'"
    for c in "\n\t":
        out = out.replace(c, f"' || chr({ord(c)}) || '")
    return f"({out})" if "||" in out else out


def draw(slot: str, n: str | int, key: str = "id") -> str:
    """slot and n: SQL expressions."""
    return f"CAST(CAST('0x' || substr(md5('42:' || CAST({key} AS VARCHAR) || ':' || {slot}), 1, 8) AS UBIGINT) % {n} AS BIGINT)"


def _cells(*cells) -> str:
    shown = lambda c: "NULL" if c is None else str(c).lower() if isinstance(c, bool) else str(c) if isinstance(c, int) else "[" + ", ".join(map(q, c)) + "]" if isinstance(c, list) else q(c)
    return "(" + ", ".join(map(shown, cells)) + ")"


def _values(name: str, columns: str, kinds: str, rows: list[str]) -> str:
    """A table of constants; a first row that no join meets gives the types."""
    return f"{name}({columns}) AS (SELECT {kinds} WHERE false UNION ALL VALUES {', '.join(rows)})" if rows else f"{name}({columns}) AS (SELECT {kinds} WHERE false)"


_PART_COLUMNS = "text, alphabet, least, most, choices"
_PART_KINDS = "''::VARCHAR, ''::VARCHAR, 0, 0, []::VARCHAR[]"


def _part(p: dict) -> tuple:
    return p.get("text"), p.get("alphabet"), p.get("least", 0), p.get("most", 0), p.get("choices")


def piece(here: str, more: str = "") -> str:
    """The text of a part with the columns of _PART_COLUMNS; `more`: cases that come before."""
    n = f"least + {draw(here + " || '.n'", '(most - least + 1)')}"
    run = f"array_to_string(list_transform(range(1, {n} + 1), lambda i: substr(alphabet, {draw(here + ' || ' + q('.') + ' || CAST(i AS VARCHAR)', 'length(alphabet)')} + 1, 1)), '')"
    return f"CASE {more} WHEN text IS NOT NULL THEN text WHEN choices IS NOT NULL THEN choices[{draw(here, 'len(choices)')} + 1] ELSE {run} END"


def grammar_tables(kinds: dict[str, grammar.Kind]) -> str:
    data = grammar.table(kinds, synth.SHAPES, synth.ALPHABETS)
    heads, spans, blocks, lines, parts = [], [], [], [], []

    def add(kind: str, pool: str, some: dict) -> None:
        for n, x in enumerate(some["lines"]):
            lines.append(_cells(kind, pool, n, x["upto"], some["total"]))
            parts.extend(_cells(kind, pool, n, k, *_part(p), p.get("field"), p.get("chance"), bool(p.get("whole"))) for k, p in enumerate(x["parts"]))

    for kind, r in data.items():
        heads.append(_cells(kind, r["only"], r["pairs"], r["first"], r["shuffle"], r["sep"], r["glue"]))
        spans += [_cells(kind, what, mode, s["low"], s["high"]) for what in ("fill", "rows", "top") for mode, s in (r[what] or {}).items()]
        for section, where in ((0, "head"), (2, "tail")):
            for i, b in enumerate(r[where]):
                blocks.append(_cells(kind, section, i, b["slot"], b["when"], b["chance"]))
                add(kind, b["slot"], b["pool"])
        for name, some in r["pools"].items():
            add(kind, "filler" if name == "filler" else f"item:{name}", some)
    s = "''::VARCHAR"
    return ",\n".join([
        _values("g_kind", "kind, only_, pairs, first_, shuffle, sep, glue", f"{s}, {s}, false, false, false, {s}, {s}", heads), _values("g_span", "kind, what, mode, low, high", f"{s}, {s}, {s}, 0, 0", spans),
        _values("g_block", "kind, section, i, slot, cond, chance", f"{s}, 0, 0, {s}, {s}, 0", blocks), _values("g_line", "kind, pool, line, upto, total", f"{s}, {s}, 0, 0, 0", lines),
        _values("g_part", f"kind, pool, line, k, {_PART_COLUMNS}, field, chance, whole", f"{s}, {s}, 0, 0, {_PART_KINDS}, {s}, 0, false", parts),
    ])


def grammar_texts() -> str:
    """CTEs from b (id, kind, mode) and named (id, spot, idx, label, value, var) to texts (id, text)."""
    marker = lambda t: f"'[' || {t}.value || '|' || {t}.label || ']'"
    here = "slot || '.' || CAST(k AS VARCHAR)"
    there = f"WHEN chance IS NOT NULL THEN CASE WHEN {draw("CASE WHEN whole THEN 'flag.' || text ELSE " + here + " END", 100)} < chance THEN text ELSE '' END"
    fields = f"WHEN field = 'm' THEN marked WHEN field = 'var' THEN var " + " ".join(f"WHEN field = 'm{i}' THEN m{i}" for i in range(3))
    return f"""wanted_rows AS (SELECT b.id, s.low + {draw("'rows'", '(s.high - s.low + 1)', 'b.id')} AS n FROM b JOIN g_span s ON s.kind = b.kind AND s.mode = b.mode AND s.what = 'rows'),
fillers AS (SELECT b.id, b.kind, coalesce(w.n - (SELECT count(*) FROM named x WHERE x.id = b.id), f.low + {draw("'fill'", '(f.high - f.low + 1)', 'b.id')}) AS n FROM b JOIN g_span f ON f.kind = b.kind AND f.mode = b.mode AND f.what = 'fill' LEFT JOIN wanted_rows w USING (id)),
body0 AS (SELECT b.id, b.kind, x.idx - 1 AS i, 'row.' || x.spot AS slot, x.idx, x.label FROM b JOIN named x USING (id) UNION ALL SELECT id, kind, {grammar.FILLERS_FROM} + j, 'fill.' || j, NULL, NULL FROM (SELECT id, kind, unnest(range(0, greatest(n, 0))) AS j FROM fillers) f0),
body1 AS (SELECT x.*, k.sep, k.glue, CASE WHEN k.shuffle THEN {draw("'order.' || x.slot", 1 << 30, 'x.id')} ELSE 0 END AS o FROM body0 x JOIN g_kind k USING (kind)),
body2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, i) - 1 AS pos FROM body1),
pools AS (SELECT DISTINCT kind, pool FROM g_line),
body3 AS (SELECT x.*, CASE WHEN idx IS NULL THEN 'filler' WHEN pos = 0 AND p.pool IS NOT NULL THEN p.pool WHEN l.pool IS NOT NULL THEN l.pool ELSE 'item:' END AS pool FROM body2 x
 LEFT JOIN pools p ON p.kind = x.kind AND p.pool = 'item:^' LEFT JOIN pools l ON l.kind = x.kind AND l.pool = 'item:' || x.label),
all_rows AS (SELECT b.id, b.kind, section, i AS pos, slot, slot AS pool, glue AS sep, NULL AS idx FROM b JOIN g_block g USING (kind) JOIN g_kind USING (kind) WHERE {draw('g.cond', 100, 'b.id')} < g.chance
 UNION ALL SELECT id, kind, 1, pos, slot, pool, CASE WHEN pos = 0 THEN glue ELSE sep END, idx FROM body3),
picked AS (SELECT r.*, l.line FROM all_rows r JOIN g_line l ON l.kind = r.kind AND l.pool = r.pool AND l.upto > {draw("r.slot || '.line'", 'l.total', 'r.id')} QUALIFY row_number() OVER (PARTITION BY r.id, r.slot ORDER BY l.upto) = 1),
first_items AS (SELECT id, {', '.join(f"max(CASE WHEN idx = {i + 1} THEN {marker('n')} END) AS m{i}" for i in range(3))} FROM named n GROUP BY id),
opened AS (SELECT r.id, r.section, r.pos, r.slot, r.sep, p.k, p.text, p.alphabet, p.least, p.most, p.choices, p.field, p.chance, p.whole, {marker('v')} AS marked, v.var, f.m0, f.m1, f.m2
 FROM picked r JOIN g_part p ON p.kind = r.kind AND p.pool = r.pool AND p.line = r.line LEFT JOIN named v ON v.id = r.id AND v.idx = r.idx LEFT JOIN first_items f ON f.id = r.id),
line_texts AS (SELECT id, section, pos, sep, string_agg({piece(here, there + ' ' + fields)}, '' ORDER BY k) AS line FROM opened GROUP BY ALL),
texts AS (SELECT id, string_agg(CASE WHEN rn = 1 THEN '' ELSE sep END || line, '' ORDER BY section, pos) AS text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY section, pos) AS rn FROM line_texts) z GROUP BY id)"""


def shape_values(items: str) -> str:
    """CTEs from `items` (id, spot, label, ...) to valued (id, spot, value), shapes drawn evenly among those of the label."""
    groups, rows = {"CREDENTIAL": synth.credential_shapes(), **synth.BY_LABEL}, []
    for label, names in groups.items():
        for i, n in enumerate(names):
            rows += [_cells(label, len(names), i, k, *_part(p)) for k, p in enumerate(synth.shape_rows([n])[0]["parts"])]
    slot = "'item.' || CAST(spot AS VARCHAR)"
    digits = f"'4' || array_to_string(list_transform(range(1, 15), lambda i: CAST({draw(slot + ' || ' + q('.value.0.') + ' || CAST(i AS VARCHAR)', 10)} AS VARCHAR)), '')"
    luhn = "list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * CAST(substr(b, i, 1) AS INT) > 9 THEN 2 * CAST(substr(b, i, 1) AS INT) - 9 ELSE 2 * CAST(substr(b, i, 1) AS INT) END ELSE CAST(substr(b, i, 1) AS INT) END))"
    sep = f"list_extract(['', '-', ' '], {draw(slot + ' || ' + q('.value.sep'), 3)} + 1)"
    return f"""{_values('shapes', f'label, size, pick, k, {_PART_COLUMNS}', f"''::VARCHAR, 0, 0, 0, {_PART_KINDS}", rows)},
shape_parts AS (SELECT i.id, i.spot, s.k, s.text, s.alphabet, s.least, s.most, s.choices, 'item.' || CAST(i.spot AS VARCHAR) || '.value.' || CAST(s.k AS VARCHAR) AS here FROM {items} i JOIN shapes s ON s.label = i.label AND s.pick = {draw("'item.' || CAST(i.spot AS VARCHAR) || '.shape'", 's.size', 'i.id')}),
valued AS (SELECT id, spot, string_agg({piece('here')}, '' ORDER BY k) AS value FROM shape_parts GROUP BY ALL
 UNION ALL SELECT id, spot, substr(f, 1, 4) || sep || substr(f, 5, 4) || sep || substr(f, 9, 4) || sep || substr(f, 13, 4) FROM (SELECT *, b || CAST((10 - {luhn} % 10) % 10 AS VARCHAR) AS f FROM (SELECT id, spot, {digits} AS b, {sep} AS sep FROM {items} WHERE label = 'CREDIT_CARD') c0) c1)"""


def positives(ids: str, voiced, variable, weighted) -> str:
    """CTEs from the query `ids` (id) to positives (id, text, context, length_mode, primary_label)."""
    C = synth.CONTEXTS
    uniform = lambda slot: f"({draw(slot, 1 << 30)} / {float(1 << 30)})"
    pool = "CASE length_mode " + " ".join(f"WHEN {q(m)} THEN [{', '.join(q(c) for c, k in C.items() if m in [synth._MODE[y] for y in k.modes])}]" for m in synth.LENGTH_WEIGHTS) + " END"
    count = "CASE length_mode " + " ".join(f"WHEN {q(m)} THEN CAST({weighted(uniform(q('count')), {str(c): w for c, w in v.items()})} AS INT)" for m, v in synth.VALUE_COUNTS.items()) + " END"
    label = weighted(uniform("'label.' || CAST(spot AS VARCHAR)"), synth.LABEL_WEIGHTS)
    voices = ", ".join(q(c) for c, k in C.items() if k.voice)
    return f"""a AS (SELECT id, {weighted(uniform(q('length')), synth.LENGTH_WEIGHTS)} AS length_mode FROM ({ids}) i0),
b AS (SELECT id, length_mode AS mode, {pool}[{draw(q('context'), 1 << 30)} % len({pool}) + 1] AS kind, {count} AS n FROM a),
drawn AS (SELECT *, {label} AS label FROM (SELECT *, unnest(range(1, n + 1)) AS spot FROM b) u),
{grammar_tables(C)},
kept AS (SELECT d.id, d.spot, d.label FROM drawn d JOIN g_kind k USING (kind) WHERE k.only_ = '' OR d.label = k.only_),
taken AS (SELECT * FROM kept UNION ALL SELECT id, 99, 'CREDENTIAL' FROM b WHERE id NOT IN (SELECT id FROM kept)),
stat AS (SELECT id, count(*) AS n, count(*) FILTER (label = 'CREDENTIAL') AS c FROM taken GROUP BY id),
more AS (SELECT b.id, s.n, CASE WHEN t.low IS NOT NULL THEN t.low + {draw("'top'", '(t.high - t.low + 1)', 'b.id')} WHEN k.pairs AND s.c < 2 THEN s.n + greatest(2, 4 - s.n) ELSE s.n END AS upto
 FROM b JOIN stat s USING (id) JOIN g_kind k USING (kind) LEFT JOIN g_span t ON t.kind = b.kind AND t.mode = b.mode AND t.what = 'top'),
numbered AS (SELECT id, spot, label, row_number() OVER (PARTITION BY id ORDER BY later, spot) AS idx FROM (SELECT id, spot, label, 0 AS later FROM taken UNION ALL SELECT id, unnest(range(n + 1, upto + 1)), 'CREDENTIAL', 1 FROM more) n0),
items AS (SELECT n.* FROM numbered n JOIN b USING (id) JOIN g_kind k USING (kind) LEFT JOIN g_span r ON r.kind = b.kind AND r.mode = b.mode AND r.what = 'rows'
 WHERE n.idx <= CASE WHEN k.first_ THEN 1 ELSE coalesce(r.low + {draw("'rows'", '(r.high - r.low + 1)', 'b.id')}, {grammar.FILLERS_FROM}) END),
{shape_values('items')},
named AS (SELECT i.*, v.value, {variable('v.value', 'i.label', 'i.id', "'item.' || CAST(i.spot AS VARCHAR) || '.var'")} AS var FROM items i JOIN valued v USING (id, spot)),
{grammar_texts()},
positives AS (SELECT b.id, CASE WHEN b.kind IN ({voices}) AND {uniform("'voiced'").replace('CAST(id', 'CAST(b.id')} < {synth.VOICE_SHARE} THEN {voiced('text', 'b.id')} ELSE text END AS text, b.kind AS context, b.mode AS length_mode, d.label AS primary_label
 FROM b JOIN texts USING (id) JOIN drawn d ON d.id = b.id AND d.spot = 1)"""


_NO_ITEMS = "named AS (SELECT id, 0 AS spot, 0 AS idx, '' AS label, '' AS value, '' AS var FROM b WHERE false)"


def negatives(ids: str, weighted) -> str:
    """CTEs from the query `ids` to negatives (id, kind, text)."""
    kind = weighted(f"({draw(q('neg'), 1 << 30)} / {float(1 << 30)})", {n: w for n, (w, _) in synth.NEGATIVES.items()})
    return f"b AS (SELECT id, {kind} AS kind, 'medium' AS mode FROM ({ids}) i0),\n{grammar_tables({n: k for n, (_, k) in synth.NEGATIVES.items()})},\n{_NO_ITEMS},\n{grammar_texts()},\nnegatives AS (SELECT id, kind, text FROM b JOIN texts USING (id))"


def adversarial(ids: str, shape_value) -> str:
    A = synth.ADVERSARIAL
    made = [("CREDENTIAL", "github_pat", "adv.a"), ("CREDENTIAL", "aws_access_key", "adv.b"), ("EMAIL", "email", "adv.m")]
    named = " UNION ALL ".join(f"SELECT id, {i + 1} AS spot, {i + 1} AS idx, {q(label)} AS label, {shape_value(synth.SHAPES[shape], 'id', slot)} AS value, '' AS var FROM b" for i, (label, shape, slot) in enumerate(made))
    return f"b AS (SELECT id, list_extract([{', '.join(map(q, A))}], id % {len(A)} + 1) AS kind, 'medium' AS mode FROM ({ids}) i0),\n{grammar_tables(A)},\nnamed AS ({named}),\n{grammar_texts()}"
