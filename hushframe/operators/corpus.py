"""Corpus preparation: BIO rows, outside schemas, unions, deterministic samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.shared import settled


def keyed_order(seed: str, *keys: str) -> Column:
    """A shuffle order that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def bio_rows(rows: DataFrame, text_col: str = "text", pattern: str = rules.MARKER, drop_empty: bool = False) -> DataFrame:
    """Marked text -> (clean, entities, tokens, tags, ner_tags)."""
    out = rows.withColumn("entities", T.entities(F.col(text_col), rules.LABELS, pattern)).withColumn("clean", T.strip_markers(F.col(text_col), pattern))
    if drop_empty:
        out = out.where(F.size("entities") > 0)
    out = out.withColumn("_w", T.bio_tags(F.col("clean"), F.col("entities")))
    ids = F.create_map(*[F.lit(x) for k, tag in enumerate(rules.BIO) for x in (tag, k)])
    return out.withColumn("tokens", F.transform("_w", lambda w: w["word"])).withColumn("tags", F.transform("_w", lambda w: w["tag"])).withColumn("ner_tags", F.transform("tags", lambda t: F.element_at(ids, t))).drop("_w")


def negative_rows(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """White-space words that are all outside; rows without words go."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != "")
    return rows.withColumn("tokens", words).where(F.size("tokens") > 0).withColumn("ner_tags", F.array_repeat(F.lit(0), F.size("tokens")))


def has_target(mask: Column) -> Column:
    return F.exists(mask, lambda s: s["label"].isin(list(rules.EXTERNAL_LABELS)))


def external_bio(text: Column, spans: Column) -> Column:
    """(word, tag) from an outside corpus: spans by start, unmapped labels skipped with their text kept, the first
    word of a value is B and the others I; values without a word leave the place as it is."""
    labels = F.create_map(*[F.lit(x) for pair in rules.EXTERNAL_LABELS.items() for x in pair])
    words = lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != "")
    pair = lambda w, t: F.struct(w.alias("word"), t.alias("tag"))
    outside = lambda s: F.transform(words(s), lambda w: pair(w, F.lit("O")))
    plain = lambda s, last: F.struct(s["label"].alias("label"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["value"].alias("value"), F.lit(last).alias("last"))
    order = F.transform(F.array_sort(spans, lambda a, b: a["start"] - b["start"]), lambda s: plain(s, False))
    nothing = F.lit(None).cast("string")
    # A last element brings out what is behind the last value.
    close = F.array(F.struct(nothing.alias("label"), F.length(text).alias("start"), F.length(text).alias("end"), nothing.alias("value"), F.lit(True).alias("last")))
    kind = "struct<word:string,tag:string>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        label = F.try_element_at(labels, s["label"])
        before = outside(F.substring(text, at + 1, F.greatest(s["start"] - at, F.lit(0))))
        value = F.transform(words(s["value"]), lambda w, i: pair(w, F.concat(F.when(i == 0, "B-").otherwise("I-"), label)))
        use = label.isNotNull()
        new = F.when(s["last"], before).when(use, F.concat(before, value)).otherwise(F.array().cast(f"array<{kind}>"))
        return F.when(use & (F.size(value) > 0), s["end"]).otherwise(at), new

    return T.fold(F.concat(order, close), F.lit(0), step, kind, "int")


def keyed_rank(rows: DataFrame, by: list[str], seed: str, key: str) -> DataFrame:
    """rows with _k, the place of each in the keyed order of its group (nulls are a group), and _n, the group's size.

    Rows are counted by group and by the first three digits of their order, 4,096 cells a group; a row's place is what the
    cells before hold and its place in its own, so a window never holds more than a cell of a group."""
    group, order = F.to_json(F.struct(*by)), keyed_order(seed, key)
    cut = rows.withColumn("_g", group).withColumn("_o", order).withColumn("_c", F.substring("_o", 1, 3))
    cells = cut.groupBy("_g", "_c").agg(F.count("*").alias("_m"))
    within = Window.partitionBy("_g")
    cells = cells.select("_g", "_c", (F.sum("_m").over(within.orderBy("_c")) - F.col("_m")).alias("_before"), F.sum("_m").over(within).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_g", "_c").orderBy("_o", key))
    return cut.join(cells, ["_g", "_c"]).withColumn("_k", F.col("_before") + place).drop("_g", "_o", "_c", "_before")


def stratified_split(rows: DataFrame, strata: list[str], share: float = 0.1, seed: str = "42", key: str = "id", least: int = 10) -> DataFrame:
    """rows with `split`: of each stratum of at least `least` rows, max(1, int(n * share)) by keyed order are eval."""
    take = F.when(F.col("_n") >= least, F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))).otherwise(0)
    ranked = keyed_rank(rows, strata, seed, key)
    return ranked.withColumn("split", F.when(F.col("_k") <= take, "eval").otherwise("train")).drop("_n", "_k")


def rarest_label_split(rows: DataFrame, labels: str = "labels", seed: str = "42", key: str = "id") -> DataFrame:
    """Rows bucketed by their globally rarest label; a tenth of each bucket, one at least, is eval."""
    freq = T.unnest(rows, F.array_distinct(labels), "label").groupBy("label").agg(F.count("*").alias("freq"))
    # As many entries as labels.
    table = freq.agg(F.map_from_entries(F.collect_list(F.struct("label", "freq"))).alias("freq"))
    with_freq = rows.crossJoin(F.broadcast(table))
    ranked = F.array_sort(F.transform(F.array_distinct(labels), lambda x: F.struct(F.element_at("freq", x).alias("f"), x.alias("l"))))
    out = with_freq.withColumn("bucket", F.coalesce(F.try_element_at(ranked, F.lit(1))["l"], F.lit("O"))).drop("freq")
    out = keyed_rank(out, ["bucket"], seed, key)
    return out.withColumn("split", F.when(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10)), "eval").otherwise("train")).drop("_n", "_k")


def uncovered_buckets(rows: DataFrame, strata: list[str], split: str = "split", least: int = 10) -> DataFrame:
    """Train buckets of at least `least` rows without a row in eval."""
    train = rows.where(F.col(split) == "train").groupBy(*strata).count().where(F.col("count") >= least)
    return train.join(rows.where(F.col(split) == "eval").select(*strata).distinct(), strata, "left_anti")


def bucket_counts(rows: DataFrame, strata: list[str]) -> DataFrame:
    return rows.groupBy(*strata).count()


def dense_ids(rows: DataFrame, order: str) -> DataFrame:
    """1-based ids in order, ties by the other columns, without one task for all rows: sizes of range partitions give each
    its offset. Partitions are written once, since their bounds are drawn anew whenever they are made."""
    keys = [order, *[c for c in rows.columns if c != order]]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = settled(ordered.withColumn("_m", F.monotonically_increasing_id()), "dense")
    part, inside = F.shiftrightunsigned("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each partition.
    sizes = numbered.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    offsets = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_o"))
    return numbered.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn("id", F.col("_o") + inside + 1).drop("_m", "_p", "_o")


def keyed_sample(rows: DataFrame, k: int, seed: str = "42", key: str = "id") -> DataFrame:
    """k rows by keyed order: a sampling operator."""
    return rows.orderBy(keyed_order(seed, key), key).limit(k)


def sample_each(rows: DataFrame, by: str, k: int = 2, key: str = "id") -> DataFrame:
    """The first k rows of each group: a preview."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(key))).where(F.col("_k") <= k).drop("_k")


def weighted_choice(u: Column, weights: dict[str, float]) -> Column:
    """The name whose cumulative weight first passes u, a number below 1."""
    total, upto, out = sum(weights.values()), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        upto += weights[name] / total
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1])


def combine(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; columns by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
