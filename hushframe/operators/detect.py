"""Detection of sensitive spans: pattern catalogue, token-label aggregation, merging, validation, policy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T

SPAN = "array<struct<start:int,end:int,label:string,value:string,source:string,tier:string,score:double>>"
#: Any match of any pattern holds one of these, so other texts skip the catalogue.
HINT = r"AKIA|gh[pousr]_|sk-ant-api|eyJ|://|-----BEGIN|bc1|0x|[0-9]\.[0-9]|[0-9A-Fa-f][:-][0-9A-Fa-f]|[13][a-km-zA-HJ-NP-Z1-9]{25}"


def span(start: Column, end: Column, label: Column, value: Column, source: Column, tier: Column, score: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), label.alias("label"), value.alias("value"), source.alias("source"), tier.alias("tier"), score.cast("double").alias("score"))


def regex_spans(text: Column) -> Column:
    """Hits of the whole catalogue, pattern by pattern, each in order of place."""
    kinds = F.array(*[F.struct(F.lit(f"regex:{name}").alias("source"), F.lit(label).alias("label"), F.lit(tier).alias("tier"), F.lit(score).alias("score")) for name, label, tier, score, _ in rules.PATTERNS])
    found = T.find_each(text, [pattern for *_, pattern in rules.PATTERNS])
    named = F.zip_with(kinds, found, lambda k, hits: F.transform(hits, lambda h: span(h["start"], h["end"], k["label"], h["value"], k["source"], k["tier"], k["score"])))
    return F.when(text.rlike(HINT), F.flatten(named)).otherwise(F.array()).cast(SPAN)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def by_start(spans: Column) -> Column:
    """Stable sort by start."""
    numbered = F.transform(spans, lambda s, i: F.struct(s["start"].alias("k"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(numbered, lambda a, b: F.when(a["k"] != b["k"], a["k"] - b["k"]).otherwise(a["i"] - b["i"])), lambda x: x["s"])


def merge_spans(tagged: Column, hits: Column) -> Column:
    """Tagger spans, and the pattern hits that overlap none of them, by start."""
    return T.let(tagged, lambda t: by_start(F.concat(t, F.filter(hits, lambda h: ~F.exists(t, lambda n: overlaps(n, h))))))


def align_tokens(text: Column, tokens: Column, floor: float = rules.TOKEN_FLOOR) -> Column:
    """Place word pieces in the text with a moving cursor: (start, end, prefix, label, score). Pieces that are
    outside, unsure or not found are skipped and leave the cursor where it is."""
    kind = "struct<start:int,end:int,prefix:string,label:string,score:double>"

    def align(lower: Column) -> Column:
        def step(cursor: Column, t: Column) -> Column:
            glued = t["word"].startswith("##")
            needle = F.when(glued, F.substring(t["word"], F.lit(3), F.length(t["word"]))).otherwise(t["word"])

            def place(x: Column) -> Column:
                start, end = x["at"] - 1, x["at"] - 1 + x["n"]
                use = (x["at"] > 0) & (x["n"] > 0) & (~x["glued"] | (start - cursor < 8)) & (x["tag"]["label"] != "O") & (t["score"] >= floor)
                one = F.array(F.struct(start.alias("start"), end.alias("end"), x["tag"]["prefix"].alias("prefix"), x["tag"]["label"].alias("label"), t["score"].cast("double").alias("score")))
                return T.let(F.coalesce(use, F.lit(False)), lambda u: F.struct(F.when(u, end).otherwise(cursor).alias("now"), F.when(u, one).otherwise(F.array().cast(f"array<{kind}>")).alias("new")))

            return T.let(F.struct(F.call_function("locate", needle, lower, cursor + 1).alias("at"), F.length(needle).alias("n"), glued.alias("glued"), T.split_tag(t["entity"]).alias("tag")), place)

        return T.fold(tokens, F.lit(0), step, kind, "int")

    return T.let(F.lower(text), align)


def collapse_bio(aligned: Column) -> Column:
    """Groups of aligned tokens: an I of the last group's label extends it across any gap, everything else opens
    a new one; the score is the mean. A group is closed, and given out, when the next opens."""
    group = "struct<start:int,end:int,label:string,total:double,n:int>"

    def step(last: Column, t: Column) -> tuple[Column, Column]:
        goes_on = F.coalesce((t["prefix"] == "I") & (t["label"] == last["label"]), F.lit(False))
        longer = F.struct(last["start"].alias("start"), t["end"].alias("end"), last["label"].alias("label"), (last["total"] + t["score"]).alias("total"), (last["n"] + 1).alias("n"))
        new = F.struct(t["start"].alias("start"), t["end"].alias("end"), t["label"].alias("label"), t["score"].alias("total"), F.lit(1).alias("n"))
        closed = F.when(goes_on | last["n"].isNull(), F.array().cast(f"array<{group}>")).otherwise(F.array(last))
        return F.when(goes_on, longer).otherwise(new), closed

    # A last element closes the last group.
    end = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit("B").alias("prefix"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("score")))
    groups = T.fold(F.concat(aligned, end), F.lit(None), step, group, group)
    return F.transform(groups, lambda g: F.struct(g["start"], g["end"], g["label"], (g["total"] / g["n"]).alias("score")))


# What is cut off the edges of spans, and the words that part fused spans.
EDGES = r"""[\s=:,;"']"""
CONNECTOR = r"(?i)\s+(?:and|or|then|with|plus)\s+|\s+-\s+"


def trim_span(text: Column, s: Column) -> Column:
    def cut(inner: Column) -> Column:
        left = F.length(inner) - F.length(F.regexp_replace(inner, f"^{EDGES}+", ""))
        right = F.length(inner) - F.length(F.regexp_replace(inner, f"{EDGES}+\\z", ""))
        start = F.least(s["start"] + left, s["end"])
        return F.struct(start.alias("start"), F.greatest(s["end"] - right, start).alias("end"), s["label"].alias("label"), s["score"].alias("score"))

    return T.let(F.substring(text, s["start"] + 1, s["end"] - s["start"]), cut)


def split_connectors(text: Column, spans: Column) -> Column:
    """Cut spans at connector words, and trim the pieces; empty ones go."""
    def pieces(s: Column) -> Column:
        def cut(inner: Column) -> Column:
            found = T.find_all(inner, CONNECTOR)
            begins = F.concat(F.array(F.lit(0)), F.transform(found, lambda m: m["end"]))
            ends = F.concat(F.transform(found, lambda m: m["start"]), F.array(F.length(inner)))
            return F.zip_with(begins, ends, lambda b, e: F.struct((s["start"] + b).alias("start"), (s["start"] + e).alias("end"), s["label"].alias("label"), s["score"].alias("score")))

        return T.let(F.substring(text, s["start"] + 1, s["end"] - s["start"]), cut)

    parts = F.flatten(F.transform(spans, pieces))
    return F.filter(F.transform(parts, lambda p: trim_span(text, p)), lambda p: p["end"] > p["start"])


def aggregate_bio(text: Column, tokens: Column) -> Column:
    """Word pieces with BIO labels -> spans (start, end, label, score)."""
    groups = collapse_bio(align_tokens(text, tokens))
    return split_connectors(text, F.transform(groups, lambda g: trim_span(text, g)))


def dedupe_overlapping(spans: Column) -> Column:
    """By start, then score downwards; a span goes if the last kept one has its label and reaches past its start."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))

    def step(last: Column, s: Column) -> tuple[Column, Column]:
        drop = F.coalesce((last["label"] == s["label"]) & (last["end"] > s["start"]), F.lit(False))
        return F.when(drop, last).otherwise(F.struct(s["label"].alias("label"), s["end"].alias("end"))), F.filter(F.array(s), lambda _: ~drop)

    def kept(o: Column) -> Column:
        marked = T.fold(F.transform(o, lambda s, i: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), i.alias("i"))), F.lit(None), step, "struct<label:string,start:int,end:int,i:int>", "struct<label:string,end:int>")
        return F.transform(marked, lambda m: F.element_at(o, m["i"] + 1))

    return T.let(order, kept)


def tier_of(label: Column, default: Column | str, policy: str = "shipped") -> Column:
    tiers = F.create_map(*[F.lit(x) for pair in rules.TIERS[policy].items() for x in pair])
    return F.coalesce(F.try_element_at(tiers, label), default if isinstance(default, Column) else F.lit(default))


def tagged_spans(text: Column, spans: Column, policy: str = "shipped") -> Column:
    """Aggregated spans as detection spans with source ner."""
    return F.transform(spans, lambda s: span(s["start"], s["end"], s["label"], F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit("ner"), tier_of(s["label"], "warn", policy), s["score"]))


def matches_format(label: Column, value: Column) -> Column:
    v = F.trim(value)
    digits = F.regexp_replace(v, "[^0-9]", "")
    ssn = v.rlike(rules.STRICT_SSN) | (F.length(digits) == 9)
    card = v.rlike(rules.STRICT_CARD) & T.luhn_valid(digits)
    phone = v.rlike(rules.PHONE_LIKE) | F.length(digits).between(10, 15)
    return F.when(label == "SSN", ssn).when(label == "CREDIT_CARD", card).when(label == "PHONE", phone).otherwise(True)


def postprocess(spans: Column, policy: str = "shipped") -> Column:
    """Thresholds for tagger spans, promotion of values in a stricter format, removal of impossible ones."""
    limit = lambda s: F.when(s["tier"] == "block", rules.THRESHOLDS["block"]).otherwise(rules.THRESHOLDS["warn"])
    sure = F.filter(spans, lambda s: ~s["source"].startswith("ner") | (s["score"] >= limit(s)))

    def promote(s: Column) -> Column:
        v = F.trim(s["value"])
        plain = s["source"] == "ner"
        ssn = plain & v.rlike(rules.STRICT_SSN)
        card = plain & v.rlike(rules.STRICT_CARD) & T.luhn_valid(F.regexp_replace(v, "[^0-9]", ""))
        label = F.when(ssn, "SSN").when(card, "CREDIT_CARD").otherwise(s["label"])
        source = F.when(ssn, "ner+format-override").when(card, "ner+luhn-override").otherwise(s["source"])
        return span(s["start"], s["end"], label, s["value"], source, F.when(ssn | card, "block").otherwise(s["tier"]), s["score"])

    possible = F.filter(F.transform(sure, promote), lambda s: ~s["source"].startswith("ner") | matches_format(s["label"], s["value"]))
    return F.transform(possible, lambda s: span(s["start"], s["end"], s["label"], s["value"], s["source"], tier_of(s["label"], s["tier"], policy), s["score"]))


def override_tiers(spans: Column, overrides: Column) -> Column:
    """Tiers of a user's map (label -> tier) over those detected."""
    return F.transform(spans, lambda s: span(s["start"], s["end"], s["label"], s["value"], s["source"], F.coalesce(F.try_element_at(overrides, s["label"]), s["tier"]), s["score"]))


def of_tier(spans: Column, tier: str) -> Column:
    return F.filter(spans, lambda s: s["tier"] == tier)


def detect(docs: DataFrame, text_col: str = "text", provider: Callable[[DataFrame], DataFrame] | None = None, tokens_col: str = "tokens", policy: str = "shipped") -> DataFrame:
    """docs with a column `spans`. A provider adds, per chunk, the tagger's pieces in tokens_col; without one only
    the catalogue is used and the plan stays in the JVM. Patterns read the whole text, the tagger its chunks. A provider
    that reports errors in a column `error` makes docs have one too: of a text's chunks the first error, null if none failed;
    the spans of a text that failed are those of the catalogue."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if provider is None:
        return docs.withColumn("spans", postprocess(regex_spans(text), policy))
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    # The row number is only joined within this plan; pieces of one text are few.
    pieces = provider(docs.select("_row", F.explode(T.chunks(text)).alias("c")).select("_row", F.col("c.pos").alias("pos"), F.col("c.chunk").alias("chunk")))
    guarded = "error" in pieces.columns
    failed = [F.col("error").alias("_error")] if guarded else []
    found = pieces.select("_row", "pos", aggregate_bio(F.col("chunk"), F.col(tokens_col)).alias("s"), *failed)
    moved = found.select("_row", "pos", *(["_error"] if guarded else []), F.transform("s", lambda s: F.struct((s["start"] + F.col("pos")).alias("start"), (s["end"] + F.col("pos")).alias("end"), s["label"], s["score"])).alias("s"))
    tagged = moved.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"])).alias("ner"), F.count("*").alias("n"), *([F.min_by("_error", F.when(F.col("_error").isNotNull(), F.col("pos"))).alias("_error")] if guarded else []))
    joined = docs.join(tagged, "_row", "left")
    ner = F.when(F.col("n") > 1, dedupe_overlapping(F.col("ner"))).otherwise(F.col("ner"))
    if guarded:
        ner = F.when(F.col("_error").isNull(), ner)
    spans = F.coalesce(tagged_spans(text, ner, policy), F.array().cast(SPAN))
    out = joined.withColumn("spans", postprocess(merge_spans(spans, regex_spans(text)), policy)).drop("_row", "ner", "n")
    return out.withColumn("error", F.col("_error")).drop("_error") if guarded else out


_LOADED: dict[str, Callable] = {}


def tagger(load: Callable[[], Callable[[list[str]], list[list[dict]]]], name: str = "tagger", guarded: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A provider for detect() from a token tagger in Python. load() gives a function from texts to their word pieces,
    dicts of entity, score, index and word; it is called once in each Python worker, at its first batch, and what it
    returns stays there. Chunks come and go in Arrow batches.

    guarded: errors become data. If a batch fails, its texts are tried one by one, and those that fail alone have no
    pieces and their error in the column `error`; so has every text of a batch before which load() failed. An answer
    of the wrong length or shape is an error too. Nothing of it fails the job."""
    pieces = "array<struct<entity:string,score:double,index:int,word:string>>"

    def answered(texts: list[str]) -> list[list[dict]]:
        if name not in _LOADED:
            _LOADED[name] = load()
        found = _LOADED[name](texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} answers to {len(texts)} texts")
        return [[{"entity": str(p["entity"]), "score": float(p["score"]), "index": int(p["index"]), "word": str(p["word"])} for p in x] for x in found]

    def tried(texts: list[str]) -> tuple[list[list[dict]], list[str | None]]:
        try:
            return answered(texts), [None] * len(texts)
        except Exception as error:
            said = f"{type(error).__name__}: {error}"[:500]
            if len(texts) == 1 or name not in _LOADED:
                return [[] for _ in texts], [said] * len(texts)
            each = [tried([t]) for t in texts]
            return [x[0][0] for x in each], [x[1][0] for x in each]

    def provider(chunks: DataFrame) -> DataFrame:
        def run(frames):
            for frame in frames:
                texts = frame["chunk"].tolist()
                if guarded:
                    found, errors = tried(texts)
                    yield frame.assign(tokens=found, error=errors)
                else:
                    yield frame.assign(tokens=answered(texts))

        return chunks.mapInPandas(run, f"{T.fields(chunks)}, tokens {pieces}" + (", error string" if guarded else ""))

    return provider


def mask(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """docs with the spans of tier block replaced in a column `masked`."""
    return docs.withColumn("masked", T.replace_spans(F.col(text_col), of_tier(F.col(spans_col), "block")))


def anti_interval_join(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of hits (doc_id, start, end) that overlap no row of spans of their document, by a sweep: of all spans that begin
    before a hit's end, one reaches past its start if the farthest does. Hits and spans of a document go by one line, in one
    sort, so many of them are no product. Rows with a null in doc_id, start or end overlap nothing."""
    line = Window.partitionBy("doc_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At one place hits come first: a span that begins where a hit ends does not overlap it.
    row = F.struct(*[F.col(f"`{c}`") for c in hits.columns])
    h = hits.select("doc_id", F.col("end").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_end"), row.alias("_row"))
    known = spans.where("doc_id is not null and start is not null and end is not null")
    s = known.select("doc_id", F.col("start").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.col("end").cast("long").alias("_end"), F.lit(None).cast(hits.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    swept = h.unionByName(s).withColumn("_far", F.max("_end").over(line)).where("_kind = 0")
    met = F.col("doc_id").isNotNull() & F.col("_at").isNotNull() & (F.col("_far") > F.col("_row.start"))
    return swept.where(~F.coalesce(met, F.lit(False))).select("_row.*")
