"""Evaluation of spans and tags: greedy interval matching, scorecards, class weights, entity F1, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T


def greedy_match(expected: Column, predicted: Column) -> Column:
    """For each expected span in order, the place of the first unmatched prediction that overlaps it, or -1."""
    numbered = F.transform(predicted, lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), i.alias("i")))

    def match(all_p: Column) -> Column:
        def step(used: Column, e: Column) -> tuple[Column, Column]:
            free = F.filter(all_p, lambda p: (p["end"] > e["start"]) & (e["end"] > p["start"]) & ~F.array_contains(used, p["i"]))
            pick = F.try_element_at(free, F.lit(1))["i"]
            return F.when(pick.isNotNull(), F.concat(used, F.array(pick))).otherwise(used), F.array(F.coalesce(pick, F.lit(-1)))

        return T.fold(expected, F.array().cast("array<int>"), step, "int", "array<int>")

    return T.let(numbered, match)


def match_counts(docs: DataFrame, expected: str = "expected", predicted: str = "predicted", slack: int = 2) -> DataFrame:
    """docs with n_expected, n_predicted, detected, correct_label, tight_boundary, false_positives."""
    e, p = F.col(expected), F.col(predicted)
    found = docs.withColumn("_m", greedy_match(e, p))
    pairs = F.filter(F.transform(F.arrays_zip(e, F.col("_m")), lambda r: F.struct(r[expected].alias("e"), F.try_element_at(p, F.greatest(r["_m"] + 1, F.lit(1))).alias("p"), r["_m"].alias("i"))), lambda r: r["i"] >= 0)
    found = found.withColumn("_p", pairs)
    n = lambda keep: F.size(F.filter("_p", keep)).cast("long")
    tight = lambda r: (F.abs(r["p"]["start"] - r["e"]["start"]) <= slack) & (F.abs(r["p"]["end"] - r["e"]["end"]) <= slack)
    return found.select(*docs.columns, F.size(e).cast("long").alias("n_expected"), F.size(p).cast("long").alias("n_predicted"), F.size("_p").cast("long").alias("detected"), n(lambda r: r["p"]["label"] == r["e"]["label"]).alias("correct_label"), n(tight).alias("tight_boundary"), (F.size(p) - F.size("_p")).cast("long").alias("false_positives"))


def scorecard(docs: DataFrame, category: str = "category", **names: str) -> DataFrame:
    """Sums of the match counts for each category, and the share detected in percent."""
    counted = match_counts(docs.withColumn(category, F.coalesce(F.col(category), F.lit("unknown"))), **names)
    sums = [F.sum(c).alias(c) for c in ("n_expected", "n_predicted", "detected", "correct_label", "tight_boundary", "false_positives")]
    out = counted.groupBy(category).agg(F.count("*").alias("total"), *sums)
    return out.withColumn("detect_pct", F.when(F.col("n_expected") > 0, F.col("detected") * 100.0 / F.col("n_expected")).otherwise(0.0))


def compare_scorecards(old: DataFrame, new: DataFrame, category: str = "category") -> DataFrame:
    """New scores beside old ones; categories without old ones keep nulls."""
    o = old.select(category, F.col("detect_pct").alias("old_pct"))
    return new.select(category, F.col("detect_pct").alias("new_pct")).join(o, category, "left").withColumn("change", F.col("new_pct") - F.col("old_pct"))


def tag_distribution(rows: DataFrame, tags: str = "ner_tags", order: str = "id", limit: int | None = 5000) -> DataFrame:
    """Counts and shares of tags, over all rows without a limit; a limit gives the preview over the first rows."""
    some = rows if limit is None else rows.orderBy(order).limit(limit)
    some = T.unnest(some, tags, "tag").groupBy("tag").count()
    return some.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()))


def class_weights(rows: DataFrame, labels: str = "labels", n_labels: int = len(rules.BIO), cap: float = 6.0, ignore: int = -100) -> DataFrame:
    """total / (n_labels * count) for each label id, at most cap; 1 for absent ones."""
    counts = T.unnest(rows, labels, "label_id").where(F.col("label_id") != ignore).groupBy("label_id").count()
    total = counts.agg(F.sum("count").alias("total"))
    every = rows.sparkSession.range(n_labels).select(F.col("id").cast("int").alias("label_id"))
    out = every.join(counts, "label_id", "left").crossJoin(F.broadcast(total))
    weight = F.when(F.col("count").isNull(), 1.0).otherwise(F.col("total") / (F.lit(n_labels) * F.col("count")))
    return out.select("label_id", F.least(F.lit(cap), weight).alias("weight"))


def tag_entities(tags: DataFrame, key: str = "id") -> DataFrame:
    """(key, pos, tag) -> entities (key, label, start, end): islands of tags, opened by B, by an I of another
    label, or after O; ends exclusive."""
    w = Window.partitionBy(key).orderBy("pos")
    t = tags.where("tag is not null").withColumn("prefix", F.when(F.col("tag") == "O", "O").otherwise(F.left("tag", F.lit(1)))).withColumn("label", F.when(F.col("tag") != "O", F.substring("tag", F.lit(3), F.length("tag"))))
    before, label_before = F.lag("prefix").over(w), F.lag("label").over(w)
    opens = (F.col("prefix") != "O") & ((F.col("prefix") == "B") | before.isNull() | (before == "O") | (label_before != F.col("label")))
    t = t.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("island", F.sum("opens").over(w)).where("prefix != 'O'")
    return t.groupBy(key, "island").agg(F.first("label").alias("label"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("island")


def _scores(sides: DataFrame, key: str) -> DataFrame:
    """sides: (key, label, start, end, e, p) with e or p 1; one shuffle brings both sides of an entity together."""
    both = sides.groupBy(key, "label", "start", "end").agg(F.max("e").alias("e"), F.max("p").alias("p"))
    agg = [F.sum("e").alias("expected"), F.sum("p").alias("predicted"), F.sum(F.col("e") * F.col("p")).alias("correct")]
    # label and the grand total in one pass
    sums = both.rollup("label").agg(*agg).withColumn("label", F.coalesce("label", F.lit("micro")))
    div = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = sums.withColumn("precision", div("correct", "predicted")).withColumn("recall", div("correct", "expected"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def entity_scores(expected: DataFrame, predicted: DataFrame, key: str = "id") -> DataFrame:
    """Exact-match counts of different entities, precision, recall and F1 of each label, and of all under `micro`."""
    side = lambda df, e, p: df.select(key, "label", "start", "end", F.lit(e).alias("e"), F.lit(p).alias("p"))
    return _scores(side(expected, 1, 0).union(side(predicted, 0, 1)), key)


def entity_scores_of(docs: DataFrame, expected: str, predicted: str, key: str = "id") -> DataFrame:
    """entity_scores() of two array columns, each row read once."""
    side = lambda c, e, p: F.transform(c, lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["end"].alias("end"), F.lit(e).alias("e"), F.lit(p).alias("p")))
    found = T.unnest(docs, F.concat(side(expected, 1, 0), side(predicted, 0, 1)), "s", key)
    return _scores(found.select(key, "s.*"), key)


def best_epoch(history: DataFrame) -> DataFrame:
    """The epoch of the greatest F1; the first of equals."""
    return history.orderBy(F.desc("f1"), "epoch").limit(1)


def label_frequency(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """In how many rows each label occurs."""
    return T.unnest(rows, F.array_distinct(labels), "label").groupBy("label").count()


def eval_share(rows: DataFrame, split: str = "split", labels: str = "labels", low: float = 7.0, high: float = 13.0) -> DataFrame:
    """Each label's share in the eval split in percent, flagged outside the bounds."""
    n = T.unnest(rows, F.array_distinct(labels), "label", split).groupBy("label").agg(F.count("*").alias("total"), F.count_if(F.col(split) == "eval").alias("in_eval"))
    return n.withColumn("eval_pct", F.col("in_eval") * 100.0 / F.col("total")).withColumn("flag", ~F.col("eval_pct").between(low, high))
