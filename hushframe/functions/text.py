"""Text operators as columns. Offsets are code points, from 0, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules


def spark_pattern(pattern: str) -> str:
    return pattern.replace(r"\b", rules.EDGE)


def fields(df: DataFrame) -> str:
    """The columns of a table as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def unnest(df: DataFrame, array: Column | str, name: str, *keep: str | Column, at: str | None = None) -> DataFrame:
    """Rows (keep, name), or (keep, at, name) with places, for the elements of an array, none of which is null. A plain
    explode makes the optimizer test the array for emptiness below it, so that the array is computed up to three times."""
    outer = F.explode_outer(array).alias(name) if at is None else F.posexplode_outer(array).alias(at, name)
    return df.select(*keep, outer).where(F.col(name).isNotNull())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value written into the expression once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Elements of a part of an array that is folded at once: a fold that appends copies what it has, so parts are short.
PART = 64


def in_parts(rows: Column, size: int = PART) -> Column:
    """An array cut into arrays of `size` elements; the last may be shorter."""
    n = F.size(rows)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(rows, k, F.lit(size)))


def fold(rows: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column] | Column], kind: str, state: str) -> Column:
    """Array of the elements that step(state, row) -> (state, elements of this row) gives, from state to state; a step
    may also return a struct (now, new) of the two.

    Rows are folded part by part; what a part gives is appended to a short array of its own, and the parts' arrays
    are put end to end once, so the work grows with the rows and not with their square."""
    pack = lambda now, out: F.struct(now.alias("now"), out.alias("out"))
    none = lambda k: F.array().cast(f"array<{k}>")

    def one(acc: Column, row: Column) -> Column:
        found = step(acc["now"], row)
        both = found if isinstance(found, Column) else F.struct(found[0].alias("now"), found[1].alias("new"))
        return let(both, lambda r: pack(r["now"], F.concat(acc["out"], r["new"])))

    def part(acc: Column, some: Column) -> Column:
        return let(F.aggregate(some, pack(acc["now"], none(kind)), one), lambda r: pack(r["now"], F.concat(acc["out"], F.array(r["out"]))))

    def block(acc: Column, parts: Column) -> Column:
        return let(F.aggregate(parts, pack(acc["now"], none(f"array<{kind}>")), part), lambda r: pack(r["now"], F.concat(acc["out"], F.array(F.flatten(r["out"])))))

    begin = pack(start.cast(state), none(f"array<{kind}>"))
    return F.aggregate(let(rows, lambda r: in_parts(in_parts(r))), begin, block, lambda acc: F.flatten(acc["out"]))


def _pieces(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """(value, gap before it, g1, ...) of each match. One pass gives the matches; only where there are any, others
    give the gaps and groups."""
    p = spark_pattern(pattern)
    names = [f"g{g}" for g in groups]
    none = F.array().cast("array<struct<value:string,gap:string" + "".join(f",{n}:string" for n in names) + ">>")

    def cut(text: Column, hits: Column) -> Column:
        fields = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for g in groups]
        rows = F.arrays_zip(hits.alias("value"), F.slice(F.split(text, p, -1), F.lit(1), F.size(hits)).alias("gap"), *(f.alias(n) for f, n in zip(fields, names)))
        return F.when(F.size(hits) > 0, rows).otherwise(none)

    # The text is bound too: in a lambda its name could be taken for that of a new column of the same select.
    return let(text, lambda t: let(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda hits: cut(t, hits)))


def _placed(pieces: Column, names: list[str]) -> Column:
    """Pieces with their offsets, by a fold over the lengths."""
    kind = "struct<start:int,end:int,value:string" + "".join(f",{n}:string" for n in names) + ">"

    def step(at: Column, r: Column) -> tuple[Column, Column]:
        start = at + F.length(r["gap"])
        end = start + F.length(r["value"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), r["value"].alias("value"), *(r[n].alias(n) for n in names)))

    return fold(pieces, F.lit(0), step, kind, "int")


def find_all(text: Column, pattern: str, groups: tuple[int, ...] = ()) -> Column:
    """All matches: array of (start, end, value, g1, g2, ...)."""
    return _placed(_pieces(text, pattern, groups), [f"g{g}" for g in groups])


def find_each(text: Column, patterns: list[str]) -> Column:
    """find_all() for several patterns: one array for each, all placed by one and the same expression."""
    every = let(text, lambda t: F.array(*[_pieces(t, p, ()) for p in patterns]))
    return F.transform(every, lambda pieces: _placed(pieces, []))


def markers(text: Column, pattern: str = rules.MARKER) -> Column:
    """Markers with their place in the marked text: array of (start, end, value, label), any label."""
    return F.transform(find_all(text, pattern, (1, 2)), lambda m: F.struct(m["start"], m["end"], m["g1"].alias("value"), m["g2"].alias("label")))


def strip_markers(text: Column, pattern: str = rules.MARKER) -> Column:
    return F.regexp_replace(text, pattern, "$1")


def entities(text: Column, labels: list[str] = rules.LABELS, pattern: str = rules.MARKER) -> Column:
    """Entities of known labels with their place in the text without markers."""
    def step(cut: Column, m: Column) -> tuple[Column, Column]:
        start = m["start"] - cut
        end = start + F.length(m["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), m["label"].alias("label"), m["value"].alias("value")))
        return cut + m["end"] - m["start"] - F.length(m["value"]), F.when(m["label"].isin(labels), one).otherwise(F.array().cast(f"array<{kind}>"))

    kind = "struct<start:int,end:int,label:string,value:string>"
    return fold(markers(text, pattern), F.lit(0), step, kind, "int")


def annotate(value: Column, label: Column) -> Column:
    return F.concat(F.lit("["), value, F.lit("|"), label, F.lit("]"))


def bio_tags(text: Column, ents: Column) -> Column:
    """(word, tag) of each white-space word: the entity at its first character gives the tag, or else the one at its
    middle; B where the entity starts just there."""
    def tag(w: Column, near: Column) -> Column:
        here = lambda at: F.filter(near, lambda e: (e["start"] <= at) & (at < e["end"]))
        start, middle = w["start"], w["start"] + F.floor((w["end"] - w["start"]) / 2).cast("int")
        name = lambda at: let(F.try_element_at(here(at), F.lit(1)), lambda e: F.when(e.isNotNull(), F.concat(F.when(e["start"] == at, "B-").otherwise("I-"), e["label"])))
        return F.struct(w["value"].alias("word"), F.coalesce(name(start), name(middle), F.lit("O")).alias("tag"))

    def tags(some: Column, all_ents: Column) -> Column:
        # Only the entities that reach into this part of the words are looked through for each word.
        first, last = F.element_at(some, 1)["start"], F.element_at(some, -1)["end"]
        return let(F.filter(all_ents, lambda e: (e["start"] < last) & (e["end"] > first)), lambda near: F.transform(some, lambda w: tag(w, near)))

    words = find_all(text, r"\S+")
    return let(ents, lambda e: F.flatten(F.transform(let(words, lambda w: in_parts(w)), lambda some: tags(some, e))))


def shape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, rules.MARKER, "[X]"), "[0-9]+", "N"), "[a-f0-9]{7,}", "H")


def shape_hash(text: Column) -> Column:
    return F.md5(shape(text))


def replace_spans(text: Column, spans: Column, mask: Callable[[Column], Column] | None = None) -> Column:
    """Put the mask of its label, or mask(span), for each span. Spans that overlap are put in from the last start to
    the first, each into the text as it then is; others in one pass over the pieces between them."""
    put = mask or (lambda s: F.concat(F.lit(rules.MASK_HEAD), s["label"], F.lit(rules.MASK_TAIL)))
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]))

    def one_pass(text: Column, up: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(up, lambda s: s["end"]))
        ends = F.concat(F.transform(up, lambda s: s["start"]), F.array(F.length(text)))
        gaps = F.zip_with(begins, ends, lambda b, e: F.substring(text, b + 1, F.greatest(e - b, F.lit(0))))
        return F.array_join(F.zip_with(gaps, F.concat(F.transform(up, put), F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")

    def one_by_one(text: Column, up: Column) -> Column:
        return F.aggregate(F.reverse(up), text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), put(s), F.substring(t, s["end"] + 1, F.length(t))))

    def choose(text: Column, up: Column) -> Column:
        crossed = F.exists(F.zip_with(up, F.slice(up, F.lit(2), F.size(up)), lambda a, b: F.coalesce(a["end"] > b["start"], F.lit(False))), lambda x: x)
        return F.when(F.size(up) == 0, text).when(crossed, one_by_one(text, up)).otherwise(one_pass(text, up))

    return let(text, lambda t: let(order, lambda up: choose(t, up)))


def mask_value(value: Column) -> Column:
    v = F.trim(F.coalesce(value, F.lit("")))
    n = F.length(v)
    dots = lambda k: F.repeat(F.lit("•"), k)
    return F.when(n <= 6, dots(n)).when(n <= 14, F.concat(F.left(v, F.lit(2)), dots(n - 4), F.right(v, F.lit(2)))).otherwise(F.concat(F.left(v, F.lit(6)), dots(F.lit(6)), F.right(v, F.lit(4))))


def split_tag(entity: Column) -> Column:
    """(prefix, label); names without B- or I- are I."""
    tagged = entity.rlike(r"^[BI]-(?s:.+)$")
    return F.struct(F.when(tagged, F.left(entity, F.lit(1))).otherwise("I").alias("prefix"), F.when(tagged, F.substring(entity, F.lit(3), F.length(entity))).otherwise(entity).alias("label"))


# Readable names.
PRETTY = {
    "CREDENTIAL": "API key / password", "SSN": "Social Security number", "CREDIT_CARD": "Credit card", "EMAIL": "Email address",
    "PHONE": "Phone number", "IP_ADDRESS": "IP address", "MAC_ADDRESS": "MAC address", "CRYPTO_ADDRESS": "Crypto wallet",
}


def pretty_label(raw: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(raw, F.lit("")), "^[BI]-", "")
    known = F.create_map(*[F.lit(x) for pair in PRETTY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, clean), F.translate(F.lower(clean), "_", " "))


def strip_prefixes(label: Column) -> Column:
    return F.replace(F.replace(label, F.lit("B-"), F.lit("")), F.lit("I-"), F.lit(""))


def escape_html(text: Column) -> Column:
    for raw, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(put))
    return text


def chunks(text: Column, size: int = rules.CHUNK, step: int = rules.CHUNK_STEP) -> Column:
    """(pos, chunk): the whole text if it is short, or else overlapping windows."""
    whole = F.array(F.struct(F.lit(0).alias("pos"), text.alias("chunk")))
    many = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda p: F.struct(p.alias("pos"), F.substring(text, p + 1, F.lit(size)).alias("chunk")))
    return F.when(F.length(text) <= size, whole).otherwise(many)


def token_windows(tokens: Column, tags: Column, content: int = 510, step: int = 382) -> Column:
    """Windows over tokens and their BIO ids, overlapping by content - step, closed by ignored specials (-100)."""
    n = F.size(tokens)
    starts = F.when(n <= content, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - content + step - 1, F.lit(0)), F.lit(step)))
    edge = F.array(F.lit(-100))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(tokens, s + 1, F.lit(content)).alias("tokens"), F.concat(edge, F.slice(tags, s + 1, F.lit(content)), edge).alias("labels")))


def piece_labels(pieces: Column, tags: Column, inside: bool = True) -> Column:
    """Labels of word pieces, from the pieces of each word and the words' BIO ids: the first piece has the word's; the
    others continue it, a B as I, or with inside=False are ignored (-100)."""
    follow = lambda t: F.when((t > 0) & (t % 2 == 1), t + 1).otherwise(t) if inside else F.lit(-100)
    return F.flatten(F.zip_with(pieces, tags, lambda p, t: F.transform(p, lambda x, i: F.when(i == 0, t).otherwise(follow(t)))))


def outside_markers(text: Column, change: Callable[[Column], Column], pattern: str = rules.MARKER) -> Column:
    """change() applied to what is between markers; markers stay byte for byte."""
    gaps = F.transform(F.split(text, pattern, -1), change)
    hits = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, h)), "")


def contract(text: Column) -> Column:
    text = F.lower(text)
    for long, short in rules.CONTRACTIONS:
        text = F.replace(text, F.lit(long), F.lit(short))
    return text


def luhn_valid(digits: Column) -> Column:
    return F.length(digits).between(12, 19) & digits.rlike("^[0-9]+$") & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def dismiss_ms(n: Column) -> Column:
    (a, x), (b, y), (c, z) = rules.DISMISS_MS
    return F.when(n <= a, x).when(n <= b, y).when(n <= c, z).otherwise(0)


def cooldown_minutes(n: Column) -> Column:
    """1 to 120, 5 where none is set."""
    return F.least(F.lit(120), F.greatest(F.lit(1), F.coalesce(F.nullif(n, F.lit(0)), F.lit(5))))


def draw(seed: str, key: Column, slot: str | Column, n: int | Column) -> Column:
    """A number below n from the first 8 hex digits of md5(seed:key:slot)."""
    slot = slot if isinstance(slot, Column) else F.lit(slot)
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), slot.cast("string"))), 1, 8), 16, 10).cast("long"), n)
