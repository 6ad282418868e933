"""Corpus audits over rows (id, text) with inline markers: conditional sums in one pass where possible."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T


def occurrences(rows: DataFrame) -> DataFrame:
    """One row for each marker: (id, pos, start, end, value, label)."""
    return T.unnest(rows, T.markers(F.col("text")), "m", "id", at="pos").select("id", "pos", "m.start", "m.end", "m.value", "m.label")


def structural(rows: DataFrame, expect_positive: bool = True) -> DataFrame:
    """Counts of broken markers, in one row. Empty values and unknown labels count each time, the others by row."""
    m = T.markers(F.col("text"))
    known = F.array(*map(F.lit, rules.LABELS))
    loose = F.regexp_replace("text", rules.MARKER, "").rlike(r"\|(?:CREDENTIAL|EMAIL|SSN)\]")
    per = rows.select(
        F.size(F.filter(m, lambda x: x["value"] == "")).alias("empty"),
        F.size(F.filter(m, lambda x: ~F.array_contains(known, x["label"]))).alias("unknown"),
        F.size(m).alias("n"),
        loose.cast("int").alias("loose"),
    )
    wrong = F.sum((F.col("n") == 0).cast("int")) if expect_positive else F.sum((F.col("n") > 0).cast("int"))
    total = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return per.agg(total(F.sum("empty")).alias("empty_value"), total(F.sum("unknown")).alias("unknown_label"), total(wrong).alias("positive_without_marker" if expect_positive else "negative_with_marker"), total(F.sum("loose")).alias("unparsed_marker"))


def first_examples(rows: DataFrame, condition: Column, k: int = 5) -> DataFrame:
    """The k least ids that meet a condition: a top-k report."""
    return rows.where(condition).orderBy("id").select("id").limit(k)


def variable_rules(spark: SparkSession) -> DataFrame:
    """(var, kind, prefixes, len): a table of some fifty rows."""
    some = [(v, "starts_with", list(p), None) for v, p in rules.VARIABLE_PREFIXES.items()] + [(v, "len_eq", None, n) for v, n in rules.VARIABLE_LENGTHS.items()]
    return spark.createDataFrame(some, "var string, kind string, prefixes array<string>, len int")


def variable_values(rows: DataFrame) -> DataFrame:
    """(id, var, value) of lines VAR=[value|LABEL]."""
    line = r"(?m)^([A-Z][A-Z_0-9]+)=" + rules.MARKER
    return T.unnest(rows, T.find_all(F.col("text"), line, (1, 2, 3)), "m", "id").select("id", F.col("m.g1").alias("var"), F.col("m.g2").alias("value"), F.col("m.g3").alias("label"))


def variable_mismatches(rows: DataFrame) -> DataFrame:
    """Values that do not suit the variable they are given to; unknown variables pass."""
    found = variable_values(rows).join(F.broadcast(variable_rules(rows.sparkSession)), "var")
    fits = F.when(F.col("kind") == "starts_with", F.exists("prefixes", lambda p: F.col("value").startswith(p))).otherwise(F.length("value") == F.col("len"))
    return found.where(~fits).select("id", "var", "value")


def semantic(rows: DataFrame, checks: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Counts of values that do not look like their label. checks: further ones by name, each a condition on
    (value, label) that holds for a bad value."""
    v, label = F.col("value"), F.col("label")
    cred = label == "CREDENTIAL"
    count = lambda c, name: F.count_if(c).alias(name)
    bad = [count((label == k) & ~v.rlike(p), f"{k.lower()}_bad_format") for k, p in rules.AUDIT_FORMATS.items()]
    looks = [count(cred & v.rlike(rules.AUDIT_FORMATS["SSN"]), "cred_looks_like_ssn"), count(cred & v.rlike(r"^[0-9\s\-]{15,19}$"), "cred_looks_like_cc"), count(cred & v.rlike(rules.AUDIT_FORMATS["EMAIL"]), "cred_looks_like_email")]
    return occurrences(rows).agg(*looks, *bad, *[count(check(v, label), name) for name, check in (checks or {}).items()])


def length_percentiles(rows: DataFrame) -> DataFrame:
    """Places in the sorted lengths, found from counts of each length: no task sorts or holds all rows."""
    counts = rows.groupBy(F.length("text").alias("len")).count()
    # As many rows as there are different lengths.
    run = Window.orderBy("len")
    placed = counts.withColumn("upto", F.sum("count").over(run)).withColumn("n", F.sum("count").over(Window.partitionBy()))
    return placed.agg(*_percentiles())


def _percentiles() -> list[Column]:
    n = F.col("n")
    target = lambda q, low: F.when(n > 100, F.floor(n * F.lit(q))).otherwise(F.lit(0) if low else n - 1)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("len")))
    return [at(target(0.01, True)).alias("p1"), at(F.floor(n / 2)).alias("p50"), at(target(0.99, False)).alias("p99")]


def diversity(rows: DataFrame) -> DataFrame:
    """Rows, distinct shapes and their share in percent."""
    shapes = rows.groupBy(T.shape_hash(F.col("text")).alias("shape")).count()
    return shapes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count("*").alias("unique_shapes")).withColumn("diversity_pct", F.when(F.col("rows") > 0, F.col("unique_shapes") * 100.0 / F.col("rows")).otherwise(0.0))


#: Precision of sketches: 2**12 registers, a standard error of 1.04 / 64, some 1.6 %.
SKETCH_BITS = 12


def shape_sketches(rows: DataFrame, *by: str, bits: int = SKETCH_BITS) -> DataFrame:
    """(by..., rows, sketch): a mergeable sketch of the distinct shapes of each group, of a size that does not depend on it. Kept
    by day and split, sketches give distinct shapes of any union without reading the texts again."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.hll_sketch_agg(T.shape_hash(F.col("text")), F.lit(bits)).alias("sketch"))


def merged_diversity(sketches: DataFrame, *by: str) -> DataFrame:
    """(by..., rows, unique_estimate, diversity_pct) of unions of groups; null texts have no shape."""
    out = sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_estimate"))
    return out.withColumn("diversity_pct", F.when(F.col("rows") > 0, F.col("unique_estimate") * 100.0 / F.col("rows")).otherwise(0.0))


def occurrence_cube(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., label, level, n): markers by every subset of the columns and the label; level is the grouping id, whose bits
    tell which of the columns, the label last, are summed over. Nulls of the data and of sums over are told apart by it."""
    found = T.unnest(rows, T.markers(F.col("text")), "m", *by).select(*by, F.col("m.label").alias("label"))
    return found.cube(*by, "label").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def top_repeats(rows: DataFrame, k: int = 5) -> DataFrame:
    return rows.groupBy(T.shape_hash(F.col("text")).alias("shape")).count().orderBy(F.desc("count"), "shape").limit(k)


def coverage(rows: DataFrame) -> DataFrame:
    """Each label's count, share, expected share, deviation from it in percent, and whether that is within 20."""
    spark = rows.sparkSession
    dim = spark.createDataFrame(list(rules.EXPECTED_SHARE.items()), "label string, expected double")
    counts = occurrences(rows).groupBy("label").count()
    total = counts.agg(F.sum("count").alias("total"))
    out = F.broadcast(dim).join(counts, "label", "left").crossJoin(F.broadcast(total))
    actual = F.when(F.col("total") > 0, F.coalesce("count", F.lit(0)) * 100.0 / F.col("total")).otherwise(0.0)
    out = out.select("label", F.coalesce("count", F.lit(0)).alias("n"), actual.alias("actual_pct"), F.col("expected").alias("expected_pct"))
    deviation = (F.col("actual_pct") - F.col("expected_pct")) / F.col("expected_pct") * 100
    return out.withColumn("deviation_pct", deviation).withColumn("within_tolerance", F.abs(deviation) <= 20)


def word_leaks(rows: DataFrame) -> DataFrame:
    """Credentials that hold a common word, each once."""
    pattern = T.spark_pattern(r"\b(?:" + "|".join(rules.STOP_WORDS) + r")\b")
    return occurrences(rows).where((F.col("label") == "CREDENTIAL") & F.lower("value").rlike(pattern)).select("id", "pos", "value")


def adjacent_labels(rows: DataFrame, gap: int = 5) -> DataFrame:
    """Markers followed by one of the same label at most `gap` characters on, in the marked text."""
    w = Window.partitionBy("id").orderBy("start")
    found = occurrences(rows).select("id", "pos", "label", "end", F.lead("start").over(w).alias("next_start"), F.lead("label").over(w).alias("next_label"))
    return found.where((F.col("label") == F.col("next_label")) & (F.col("next_start") - F.col("end") <= gap)).select("id", "pos", "label")


def cross_split(rows: DataFrame) -> DataFrame:
    """Texts that two splits share, and repeats inside each split. rows: (split, text)."""
    per = rows.groupBy("split", "text").agg(F.count("*").alias("n"))
    inside = per.groupBy("split").agg(F.sum(F.col("n") - 1).alias("n")).select(F.concat(F.lit("internal:"), F.col("split")).alias("check"), F.col("n").cast("long").alias("n"))
    # One row for each text with the splits it is in, so no pair of rows is formed.
    where = per.groupBy("text").agg(F.array_sort(F.collect_set("split")).alias("s"))
    pairs = where.where(F.size("s") > 1).select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.concat(a, F.lit("&"), b))))).alias("check"))
    return inside.union(pairs.groupBy("check").agg(F.count("*").alias("n")))


def prefix_overlap(positives: DataFrame, negatives: DataFrame, size: int = 6, least: int = 5) -> DataFrame:
    """Negatives that hold, where a value could begin, a prefix common among credentials: an equi join on
    all windows behind a border character, instead of every prefix against every text."""
    creds = occurrences(positives).where((F.col("label") == "CREDENTIAL") & (F.length("value") >= size))
    common = creds.groupBy(F.substring("value", 1, size).alias("prefix")).count().where(F.col("count") >= least).select("prefix")
    borders = F.filter(F.sequence(F.lit(1), F.greatest(F.length("text") - size, F.lit(1))), lambda i: F.substring("text", i, F.lit(1)).rlike(r"""[\s=:"']"""))
    heads = F.array_distinct(F.transform(borders, lambda i: F.substring("text", i + 1, F.lit(size))))
    return negatives.select("id", F.explode(heads).alias("prefix")).join(common, "prefix", "left_semi").select("id").distinct()


def tokenization(rows: DataFrame, count: Callable[[DataFrame], DataFrame], sample: int = 100, limit: int = 512, seed: str = "42") -> DataFrame:
    """Token counts of a sample drawn by keyed hash: a sampling report. count gives the column n of the rows drawn."""
    some = count(rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))), "id").limit(sample)).select("n")
    s = F.array_sort(F.collect_list("n"))
    n = F.count("*")
    return some.agg(n.alias("sampled"), F.try_element_at(s, F.greatest(F.lit(0), F.floor(n / 100).cast("int")) + 1).alias("p1"), F.try_element_at(s, F.floor(n / 2).cast("int") + 1).alias("p50"), F.try_element_at(s, F.least(n - 1, F.floor(n * 0.99)).cast("int") + 1).alias("p99"), F.count_if(F.col("n") > limit).alias("over_limit"), F.max("n").alias("max"))


def shared_passages(docs: DataFrame, items: DataFrame, words: int = 8, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, shared, passages): documents that hold passages of `words` white-space words of a held-out item, how
    many of its different passages, and how many it has. An equi join on passages; one that very many documents hold meets only the
    items that hold it too. Texts that are shorter have no passages."""
    def passages(rows: DataFrame, key: str) -> DataFrame:
        run = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"\s+"), lambda w: w != "")
        starts = lambda w: F.when(F.size(w) >= words, F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        cut = T.let(run, lambda w: F.array_distinct(F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, F.lit(words)), " "))))
        return T.unnest(rows.select(key, cut.alias("_p")), "_p", "passage", key)

    known = passages(items, item_id)
    sizes = known.groupBy(item_id).agg(F.count("*").alias("passages"))
    met = passages(docs, doc_id).join(known, "passage").groupBy(doc_id, item_id).agg(F.count("*").alias("shared"))
    return met.join(sizes, item_id).select(doc_id, item_id, "shared", "passages")


SPLITS = ("train", "eval", "neg")
_NAMES = {"train": "train", "eval": "eval", "neg": "negatives"}


def _variable_table() -> Column:
    some = {v: {"prefixes": list(p)} for v, p in rules.VARIABLE_PREFIXES.items()} | {v: {"len": n} for v, n in rules.VARIABLE_LENGTHS.items()}
    return F.from_json(F.lit(json.dumps(some)), "map<string,struct<prefixes:array<string>,len:int>>")


def row_measures(text: Column, checks: dict[str, Callable[[Column, Column], Column]] | None = None) -> Column:
    """What additive audits count in one marked text, as a struct of numbers; its markers are parsed once. It holds what
    structural(), semantic(), variable_mismatches(), coverage(), word_leaks() and adjacent_labels() count by row."""
    v, cred = lambda x: x["value"], lambda x: x["label"] == "CREDENTIAL"
    formats = rules.AUDIT_FORMATS
    stop = T.spark_pattern(r"\b(?:" + "|".join(rules.STOP_WORDS) + r")\b")
    by_marker = {
        "empty_value": lambda x: v(x) == "", "unknown_label": lambda x: ~x["label"].isin(rules.LABELS),
        "cred_looks_like_ssn": lambda x: cred(x) & v(x).rlike(formats["SSN"]), "cred_looks_like_cc": lambda x: cred(x) & v(x).rlike(r"^[0-9\s\-]{15,19}$"), "cred_looks_like_email": lambda x: cred(x) & v(x).rlike(formats["EMAIL"]),
        **{f"{k.lower()}_bad_format": (lambda x, k=k, p=p: (x["label"] == k) & ~v(x).rlike(p)) for k, p in formats.items()},
        **{name: (lambda x, check=check: check(v(x), x["label"])) for name, check in (checks or {}).items()},
        **{f"label_{k}": (lambda x, k=k: x["label"] == k) for k in rules.LABELS},
        "common_word_leak": lambda x: cred(x) & F.lower(v(x)).rlike(stop),
    }
    number = lambda c: c.cast("long")

    def counted(m: Column) -> Column:
        follows = F.zip_with(m, F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), lambda a, b: F.coalesce((a["label"] == b["label"]) & (b["start"] - a["end"] <= 5), F.lit(False)))
        # One argument: a second one would be taken for the place.
        each = [number(F.size(F.filter(m, (lambda c: lambda x: c(x))(c)))).alias(name) for name, c in by_marker.items()]
        return F.struct(number(F.size(m)).alias("n"), *each, number(F.size(F.filter(follows, lambda x: x))).alias("adjacent_same_label"))

    def mismatched(found: Column) -> Column:
        def bad(x: Column) -> Column:
            fits = lambda r: F.when(r["prefixes"].isNotNull(), F.exists(r["prefixes"], lambda p: x["g2"].startswith(p))).when(r["len"].isNotNull(), F.length(x["g2"]) == r["len"]).otherwise(True)
            return ~T.let(F.try_element_at(_variable_table(), x["g1"]), fits)

        return number(F.size(F.filter(found, bad)))

    text = F.coalesce(text, F.lit(""))
    line = r"(?m)^([A-Z][A-Z_0-9]+)=" + rules.MARKER
    loose = F.regexp_replace(text, rules.MARKER, "").rlike(r"\|(?:CREDENTIAL|EMAIL|SSN)\]")
    return F.struct(T.let(T.markers(text), counted).alias("m"), number(loose.cast("int")).alias("unparsed_marker"), mismatched(T.find_all(text, line, (1, 2, 3))).alias("var_value_mismatch"))


def additive(measures: str = "_a", checks: dict | None = None) -> list[Column]:
    """Sums of row_measures() for each split, as aggregates that agg() takes as well as observe()."""
    names = ["empty_value", "unknown_label", *_semantic_names(checks), *[f"label_{k}" for k in rules.LABELS], "common_word_leak", "adjacent_same_label", "n"]
    out = []
    for split in SPLITS:
        mine = F.col("split") == split
        total = lambda c, name: F.coalesce(F.sum(F.when(mine, c)), F.lit(0)).cast("long").alias(f"{split}:{name}")  # noqa: B023, E731
        out += [total(F.col(f"{measures}.m.{n}"), n) for n in names] + [total(F.col(f"{measures}.{n}"), n) for n in ("unparsed_marker", "var_value_mismatch")]
        out += [total((F.col(f"{measures}.m.n") == 0).cast("int"), "without"), total((F.col(f"{measures}.m.n") > 0).cast("int"), "with")]
    return out


def _semantic_names(checks: dict | None) -> list[str]:
    return ["cred_looks_like_ssn", "cred_looks_like_cc", "cred_looks_like_email", *[f"{k.lower()}_bad_format" for k in rules.AUDIT_FORMATS], *(checks or {})]


def _additive_report(sums: dict[str, int], checks: dict | None) -> dict:
    out: dict = {}
    for split in SPLITS:
        got = lambda name: sums[f"{split}:{name}"]  # noqa: B023, E731
        marker = {"negative_with_marker": got("with")} if split == "neg" else {"positive_without_marker": got("without")}
        out[_NAMES[split]] = {"structural": {"empty_value": got("empty_value"), "unknown_label": got("unknown_label"), **marker, "unparsed_marker": got("unparsed_marker")}}
        if split != "neg":
            out[_NAMES[split]]["semantic"] = {n: got(n) for n in _semantic_names(checks)} | {"var_value_mismatch": got("var_value_mismatch")}
    both = lambda name: sums[f"train:{name}"] + sums[f"eval:{name}"]
    total, out["coverage"] = both("n"), {}
    for label, expected in rules.EXPECTED_SHARE.items():
        n = both(f"label_{label}")
        actual = n * 100.0 / total if total else 0.0
        deviation = (actual - expected) / expected * 100
        out["coverage"][label] = {"label": label, "n": n, "actual_pct": actual, "expected_pct": expected, "deviation_pct": deviation, "within_tolerance": abs(deviation) <= 20}
    out["hygiene"] = {"common_word_leak_count": both("common_word_leak"), "adjacent_same_label_count": both("adjacent_same_label")}
    flat = [v for k in ("train", "eval") for part in ("structural", "semantic") for v in out[k][part].values()] + list(out["negatives"]["structural"].values())
    out["summary"] = {"passed": not any(flat), "failures": int(sum(flat))}
    return out


def audited_write(rows: DataFrame, path: str, strict: bool = False, checks: dict | None = None, text_col: str = "text") -> dict:
    """Write rows (split, text, ...) as Parquet and audit them in the same scan: the additive part of the report comes from
    observed sums of the write itself. strict: a row that an audit counts as a failure fails the write, and nothing is committed."""
    seen = Observation("audit")
    measured = rows.withColumn("_a", row_measures(F.col(text_col), checks)).observe(seen, *additive("_a", checks))
    if strict:
        m = lambda n: F.col(f"_a.m.{n}")
        marked = [m("n") == 0, *[m(n) > 0 for n in _semantic_names(checks)], F.col("_a.var_value_mismatch") > 0]
        wrong = (m("empty_value") > 0) | (m("unknown_label") > 0) | (F.col("_a.unparsed_marker") > 0)
        bad = F.coalesce(wrong | F.when(F.col("split") == "neg", m("n") > 0).otherwise(reduce(lambda a, b: a | b, marked)), F.lit(False))
        measured = measured.where(F.when(bad, F.raise_error(F.concat(F.lit("audit: this text fails: "), F.left(F.coalesce(F.col(text_col), F.lit("")), F.lit(80)))).isNull()).otherwise(True))
    measured.drop("_a").write.parquet(path)
    return _additive_report(seen.get, checks)


def report(train: DataFrame, evals: DataFrame, negatives: DataFrame, checks: dict[str, Callable[[Column, Column], Column]] | None = None) -> dict:
    """The nested audit report; every part is a few numbers. checks: those of semantic(). Each text's markers are parsed once,
    for all the sums together; shapes, lengths, repeats and prefixes take a shuffle each, for all splits together."""
    rows = train.select("id", F.lit("train").alias("split"), "text").union(evals.select("id", F.lit("eval"), "text")).union(negatives.select("id", F.lit("neg"), "text"))
    out = _additive_report(rows.withColumn("_a", row_measures(F.col("text"), checks)).agg(*additive("_a", checks)).first().asDict(), checks)
    shapes = rows.groupBy("split", T.shape_hash(F.col("text")).alias("shape")).count()
    first = F.row_number().over(Window.partitionBy("split").orderBy(F.desc("count"), "shape"))
    found = {r.split: r for r in shapes.withColumn("_k", first).groupBy("split").agg(F.sum("count").alias("rows"), F.count("*").alias("unique"), F.array_sort(F.collect_list(F.when(F.col("_k") <= 5, F.struct("_k", "count")))).alias("top")).collect()}
    lengths = rows.groupBy("split", F.length("text").alias("len")).count()
    placed = lengths.withColumn("upto", F.sum("count").over(Window.partitionBy("split").orderBy("len"))).withColumn("n", F.sum("count").over(Window.partitionBy("split")))
    sizes = {r.split: r for r in placed.groupBy("split").agg(*_percentiles()).collect()}
    for split in SPLITS:
        r, p, part = found.get(split), sizes.get(split), out[_NAMES[split]]
        n, unique = (r.rows, r.unique) if r else (0, 0)
        part["diversity"] = {"rows": n, "unique_shapes": unique, "diversity_pct": unique * 100.0 / n if n else 0.0, **{k: p[k] if p else None for k in ("p1", "p50", "p99")}}
        part["top_repeat_counts"] = [x["count"] for x in r.top] if r else []
    out["cross_split"] = {r.check: r.n for r in cross_split(rows.select("split", "text")).collect()}
    out["neg_prefix_overlap"] = prefix_overlap(rows.where("split != 'neg'"), negatives).count()
    return out


def render_markdown(found: dict) -> str:
    lines = ["# Corpus audit", "", f"Passed: {found['summary']['passed']}", "", "## Label balance", "", "| label | n | share | expected | deviation | within 20 % |", "|---|---|---|---|---|---|"]
    for label, r in sorted(found["coverage"].items()):
        lines.append(f"| {label} | {r['n']} | {r['actual_pct']:.1f} | {r['expected_pct']:.1f} | {r['deviation_pct']:.1f} | {r['within_tolerance']} |")
    for name in ("train", "eval", "negatives"):
        lines += ["", f"## {name}", ""] + [f"- {k}: {v}" for part in found[name].values() if isinstance(part, dict) for k, v in part.items()] + [f"- most repeated shapes: {found[name]['top_repeat_counts']}"]
    lines += ["", "## Across splits", ""] + [f"- {k}: {v}" for k, v in sorted(found["cross_split"].items())] + ["", f"Negatives with a credential prefix: {found['neg_prefix_overlap']}"]
    return "\n".join(lines) + "\n"


def require_clean(found: dict) -> None:
    """The strict mode: an error if anything failed."""
    if not found["summary"]["passed"]:
        raise ValueError(f"audit found {found['summary']['failures']} failures")
