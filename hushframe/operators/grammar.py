"""A weighted template grammar as data, and one expression that reads it.

A kind of text has blocks before and after its rows, a row for each item, and filler rows between them. A block or row is one
line of a pool of weighted alternatives; a line is a list of parts: text, runs of letters of an alphabet, choices, fields of the
item, and text that is there now and then. Rules say which items a kind takes, how many it is topped up to, and how many
rows it has. All of it is one constant table, so a plan does not grow with the number of kinds or lines.

Lines are written as shapes are, {X:n} for n characters of alphabet X, {a|b} for a choice, with {=name} for a named shape,
{@field} for a field of the row's item (m is its marker, m0 to m2 are the markers of the first items), {?30:text} for text in
30 of 100 rows, and {?30!:text} for text in all rows of 30 of 100 texts. A line may be (weight, line).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

MODES = ("short", "medium", "long")
#: Number of a filler row's place; items have smaller ones.
FILLERS_FROM = 1000


@dataclass(frozen=True)
class Block:
    """One line of `lines`, with a chance of `chance` in 100; blocks of one `slot` come and go together."""

    lines: tuple
    chance: int = 100
    slot: str | None = None


@dataclass(frozen=True)
class Kind:
    """modes: lengths it suits, of S, M and L. item: lines for an item, by label, '' for all others and '^' for the first row.
    fill, rows, top: (least, most) by mode: filler rows, rows in all (surplus items go), items that credentials top up to."""

    modes: str = "SML"
    voice: bool = False
    head: tuple[Block, ...] = ()
    item: dict[str, tuple] = field(default_factory=dict)
    filler: tuple = ()
    tail: tuple[Block, ...] = ()
    fill: tuple = ((0, 0), (0, 0), (0, 0))
    rows: tuple | None = None
    top: tuple | None = None
    only: str = ""
    pairs: bool = False
    first: bool = False
    shuffle: bool = False
    sep: str = "\n"
    glue: str = "\n"


def parse_line(line: str, shapes: dict[str, str], alphabets: dict[str, str]) -> list[dict]:
    out: list[dict] = []
    for literal, inner in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{([^{}]*)\}", line):
        if literal:
            out.append({"text": literal.replace("{{", "{").replace("}}", "}")})
        elif inner.startswith("="):
            out += parse_line(shapes[inner[1:]], shapes, alphabets)
        elif inner.startswith("@"):
            out.append({"field": inner[1:]})
        elif m := re.fullmatch(r"\?(\d+)(!?):(.*)", inner, re.DOTALL):
            out.append({"text": m[3], "chance": int(m[1]), "whole": bool(m[2])})
        elif m := re.fullmatch(r"([A-Z]):(\d+)(?:-(\d+))?", inner):
            out.append({"alphabet": alphabets[m[1]], "least": int(m[2]), "most": int(m[3] or m[2])})
        else:
            out.append({"choices": inner.split("|")})
    return out


def pool(lines: tuple, shapes: dict[str, str], alphabets: dict[str, str]) -> dict:
    upto, out = 0, []
    for x in lines:
        weight, line = x if isinstance(x, tuple) else (1, x)
        upto += weight
        out.append({"upto": upto, "parts": parse_line(line, shapes, alphabets)})
    return {"total": upto, "lines": out}


def table(kinds: dict[str, Kind], shapes: dict[str, str], alphabets: dict[str, str]) -> dict[str, dict]:
    """The grammar as plain data."""
    def span(x: tuple | None) -> dict | None:
        return None if x is None else {m: {"low": a, "high": b} for m, (a, b) in zip(MODES, x)}

    def blocks(some: tuple[Block, ...], where: str) -> list[dict]:
        return [{"slot": f"{where}.{i}", "when": f"{b.slot or f'{where}.{i}'}.in", "chance": b.chance, "pool": pool(b.lines, shapes, alphabets)} for i, b in enumerate(some)]

    return {
        name: {
            "head": blocks(k.head, "head"), "tail": blocks(k.tail, "tail"), "pools": {x: pool(lines, shapes, alphabets) for x, lines in (k.item | ({"filler": k.filler} if k.filler else {})).items()},
            "fill": span(k.fill), "rows": span(k.rows), "top": span(k.top), "only": k.only, "pairs": k.pairs, "first": k.first, "shuffle": k.shuffle, "sep": k.sep, "glue": k.glue,
        }
        for name, k in kinds.items()
    }


_PART = "array<struct<text:string,alphabet:string,least:int,most:int,choices:array<string>,field:string,chance:int,whole:boolean>>"
_POOL = f"struct<total:int,lines:array<struct<upto:int,parts:{_PART}>>>"
_BLOCKS = f"array<struct<slot:string,when:string,chance:int,pool:{_POOL}>>"
_SPAN = "map<string,struct<low:int,high:int>>"
_KIND = f"struct<head:{_BLOCKS},tail:{_BLOCKS},pools:map<string,{_POOL}>,fill:{_SPAN},rows:{_SPAN},top:{_SPAN},only:string,pairs:boolean,first:boolean,shuffle:boolean,sep:string,glue:string>"


def rules_of(kinds: dict[str, Kind], name: Column, shapes: dict[str, str], alphabets: dict[str, str]) -> Column:
    """The entry of a kind."""
    return F.element_at(F.from_json(F.lit(json.dumps(table(kinds, shapes, alphabets))), f"map<string,{_KIND}>"), name)


def _between(span: Column, key: Column, seed: str, slot: str) -> Column:
    return span["low"] + T.draw(seed, key, slot, span["high"] - span["low"] + 1).cast("int")


def n_rows(rule: Column, mode: Column, key: Column, seed: str) -> Column:
    """Rows in all, null where a kind does not say."""
    return F.when(rule["rows"].isNotNull(), _between(rule["rows"][mode], key, seed, "rows"))


def chosen_items(rule: Column, drawn: Column, mode: Column, key: Column, seed: str) -> Column:
    """The items (at, label) of those drawn that a kind takes, and those that it adds."""
    credential = lambda at: F.struct(at.cast("int").alias("at"), F.lit("CREDENTIAL").alias("label"))
    some = F.filter(drawn, lambda x: (rule["only"] == "") | (x["label"] == rule["only"]))
    some = T.let(some, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(credential(F.lit(99)))))

    def added(s: Column) -> Column:
        n = F.size(s)
        scarce = rule["pairs"] & (F.size(F.filter(s, lambda x: x["label"] == "CREDENTIAL")) < 2)
        upto = F.when(rule["top"].isNotNull(), _between(rule["top"][mode], key, seed, "top")).when(scarce, n + F.greatest(F.lit(2), 4 - n)).otherwise(n)
        return F.when(upto > n, F.concat(s, F.transform(F.sequence(n + 1, F.greatest(upto, n + 1)), credential))).otherwise(s)

    most = F.when(rule["first"], F.lit(1)).otherwise(F.coalesce(n_rows(rule, mode, key, seed), F.lit(FILLERS_FROM)))
    return F.slice(T.let(some, added), F.lit(1), most)


def expand(parts: Column, key: Column, seed: str, slot: Column, item: Column, items: Column) -> Column:
    """The text of a line. Each part draws from slots of its own."""
    marker = lambda x: T.annotate(x["value"], x["label"])

    def one(p: Column, k: Column) -> Column:
        here = F.concat(slot, F.lit("."), k.cast("string"))
        n = p["least"] + T.draw(seed, key, F.concat(here, F.lit(".n")), p["most"] - p["least"] + 1).cast("int")
        letter = lambda i: F.substring(p["alphabet"], T.draw(seed, key, F.concat(here, F.lit("."), i.cast("string")), F.length(p["alphabet"])).cast("int") + 1, F.lit(1))
        run = F.array_join(F.transform(F.sequence(F.lit(1), n), letter), "")
        chosen = F.element_at(p["choices"], T.draw(seed, key, here, F.size(p["choices"])).cast("int") + 1)
        there = T.draw(seed, key, F.when(p["whole"], F.concat(F.lit("flag."), p["text"])).otherwise(here), 100) < p["chance"]
        field_ = F.when(p["field"] == "m", marker(item)).when(p["field"] == "var", item["var"])
        for i in range(3):
            field_ = field_.when(p["field"] == f"m{i}", marker(F.get(items, F.lit(i))))
        return F.when(p["chance"].isNotNull(), F.when(there, p["text"]).otherwise("")).when(p["text"].isNotNull(), p["text"]).when(p["choices"].isNotNull(), chosen).when(p["field"].isNotNull(), field_).otherwise(run)

    return F.array_join(F.transform(parts, one), "")


def text_of(rule: Column, items: Column, mode: Column, key: Column, seed: str) -> Column:
    """The text of a kind with these items (at, label, value, var)."""
    number = lambda i: i.cast("string")
    row = lambda o, i, slot, item: F.struct(o.alias("o"), i.cast("int").alias("i"), slot.alias("slot"), item.cast("int").alias("item"))
    order = lambda slot: F.when(rule["shuffle"], T.draw(seed, key, F.concat(F.lit("order."), slot), 1 << 30)).otherwise(F.lit(0).cast("long"))
    fillers = F.coalesce(n_rows(rule, mode, key, seed) - F.size(items), _between(rule["fill"][mode], key, seed, "fill"))

    def filler(j: Column) -> Column:
        return T.let(F.concat(F.lit("fill."), number(j)), lambda slot: row(order(slot), j + FILLERS_FROM, slot, F.lit(-1)))

    def holding(x: Column, i: Column) -> Column:
        return T.let(F.concat(F.lit("row."), number(x["at"])), lambda slot: row(order(slot), i, slot, i))

    body = F.array_sort(F.concat(F.transform(items, holding), F.transform(F.filter(F.sequence(F.lit(0), F.greatest(fillers, F.lit(0))), lambda j: j < fillers), filler)))
    line = lambda sep, slot, some, item: F.struct(sep.alias("sep"), slot.alias("slot"), some.alias("pool"), item.alias("item"))

    def blocks(some: Column) -> Column:
        there = F.filter(some, lambda b: T.draw(seed, key, b["when"], 100) < b["chance"])
        return F.transform(there, lambda b: line(rule["glue"], b["slot"], b["pool"], F.lit(-1)))

    def of_row(r: Column, at: Column) -> Column:
        label = F.get(items, r["item"])["label"]
        named = lambda x: F.try_element_at(rule["pools"], x)
        held = F.coalesce(F.when(at == 0, named(F.lit("^"))), named(label), named(F.lit("")))
        return line(F.when(at == 0, rule["glue"]).otherwise(rule["sep"]), r["slot"], F.when(r["item"] < 0, named(F.lit("filler"))).otherwise(held), r["item"])

    def shown(x: Column, at: Column) -> Column:
        u = T.draw(seed, key, F.concat(x["slot"], F.lit(".line")), x["pool"]["total"])
        parts = T.let(u, lambda v: F.get(F.filter(x["pool"]["lines"], lambda y: y["upto"] > v), F.lit(0))["parts"])
        return F.concat(F.when(at == 0, "").otherwise(x["sep"]), expand(parts, key, seed, x["slot"], F.get(items, x["item"]), items))

    lines = T.let(body, lambda rows: F.concat(blocks(rule["head"]), F.transform(rows, of_row), blocks(rule["tail"])))
    return F.array_join(T.let(lines, lambda all_: F.transform(all_, shown)), "")
