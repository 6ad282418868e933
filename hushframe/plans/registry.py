"""All queries of the library outside the optional subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import audit, corpus, crf, detect, evaluate, policy, synth
from ..operators import word_pieces as wp
from . import oracle
from .fixtures import annotated

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): the marked texts without their markers, and all documents."""
    marked = annotated(spark, sf_dir).select(F.col("id").alias("id"), T.strip_markers(F.col("text")).alias("text"))
    docs = table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("id"), "text")
    return marked.union(docs)


def spans_rows(df: DataFrame, col: str = "s") -> DataFrame:
    return T.unnest(df, col, "s", "id").select("id", "s.start", "s.end", "s.label", "s.value", "s.source", "s.tier", "s.score")


# Detection


@query
def detect_regex_spans(spark, sf):
    return spans_rows(clean_texts(spark, sf).select("id", detect.regex_spans(F.col("text")).alias("s")))


def flagship(spark, sf):
    docs = detect.mask(detect.detect(clean_texts(spark, sf)))
    return docs.select("id", F.md5("masked").alias("masked_md5"), F.size("spans").cast("long").alias("n_spans"))


@query
def detect_and_mask(spark, sf):
    return flagship(spark, sf)


@query
def mask_documents(spark, sf):
    docs = detect.mask(detect.detect(table(spark, sf, "documents").select("doc_id", "text")))
    return docs.select("doc_id", F.length("masked").cast("long").alias("masked_len"), F.size("spans").cast("long").alias("n_spans"))


@query
def scan_conversations(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.size(detect.regex_spans(F.col("text"))).alias("n"))
    return rows.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_spans"), F.count("*").alias("turns"))


def _shifted(spark, sf):
    """(id, text, ner, hits): entities moved by a keyed shift as tagger spans, beside the pattern hits."""
    rows = annotated(spark, sf).select("id", T.strip_markers(F.col("text")).alias("text"), T.entities(F.col("text")).alias("e"))
    score = (F.pmod(F.col("id") * 37, F.lit(60)) + 40) / 100.0
    shift = (F.pmod(F.col("id"), F.lit(4))).cast("int")
    moved = F.transform("e", lambda e: F.struct((e["start"] + shift).alias("start"), F.greatest(e["end"], e["start"] + shift + 1).alias("end"), e["label"].alias("label"), score.alias("score")))
    return rows.select("id", "text", detect.tagged_spans(F.col("text"), moved).alias("ner"), detect.regex_spans(F.col("text")).alias("hits"))


@query
def merge_tagged_and_hits(spark, sf):
    return spans_rows(_shifted(spark, sf).select("id", detect.merge_spans(F.col("ner"), F.col("hits")).alias("s")))


@query
def anti_interval_join(spark, sf):
    rows = _shifted(spark, sf)
    hits = T.unnest(rows, "hits", "h", F.col("id").alias("doc_id")).select("doc_id", "h.start", "h.end", "h.source")
    return detect.anti_interval_join(hits, T.unnest(rows, "ner", "h", F.col("id").alias("doc_id")).select("doc_id", "h.start", "h.end"))


@query
def postprocess_spans(spark, sf):
    rows = annotated(spark, sf).select("id", T.strip_markers(F.col("text")).alias("text"), T.entities(F.col("text")).alias("e"))
    score = (F.pmod(F.col("id") * 37, F.lit(60)) + 40) / 100.0
    wrong = F.transform("e", lambda e: F.struct(e["start"], e["end"], F.when(F.col("id") % 5 == 0, "PHONE").otherwise(e["label"]).alias("label"), score.alias("score")))
    return spans_rows(rows.select("id", detect.postprocess(detect.tagged_spans(F.col("text"), wrong)).alias("s")))


@query
def tier_override(spark, sf):
    rows = clean_texts(spark, sf).select("id", detect.regex_spans(F.col("text")).alias("s"))
    own = F.create_map(F.lit("IP_ADDRESS"), F.lit("block"), F.lit("CREDENTIAL"), F.lit("warn"))
    s = detect.override_tiers(F.col("s"), own)
    return rows.select("id", F.size(detect.of_tier(s, "block")).cast("long").alias("n_block"), F.size(detect.of_tier(s, "warn")).cast("long").alias("n_warn"))


def word_pieces(spark, sf):
    """(id, text, tokens): words of marked texts as a tagger's pieces, cut in two, with keyed scores."""
    rows = corpus.bio_rows(annotated(spark, sf).select("id", "text"))
    words = F.arrays_zip(F.col("tokens").alias("w"), F.col("tags").alias("t"))
    def pieces(x, i):
        w = F.lower(x["w"])
        score = (F.pmod(F.col("id") * 31 + i * 17, F.lit(70)) + 30) / 100.0
        head = F.struct(x["t"].alias("entity"), score.alias("score"), i.alias("index"), F.left(w, F.lit(4)).alias("word"))
        tail = F.struct(F.replace(x["t"], F.lit("B-"), F.lit("I-")).alias("entity"), score.alias("score"), i.alias("index"), F.concat(F.lit("##"), F.substring(w, F.lit(5), F.length(w))).alias("word"))
        return F.when(F.length(w) > 4, F.array(head, tail)).otherwise(F.array(head))
    return rows.select("id", F.col("clean").alias("text"), F.flatten(F.transform(words, pieces)).alias("tokens"))


@query
def aggregate_word_pieces(spark, sf):
    rows = word_pieces(spark, sf)
    return T.unnest(rows, detect.aggregate_bio(F.col("text"), F.col("tokens")), "s", "id").select("id", "s.start", "s.end", "s.label", F.round("s.score", 9).alias("score"))


@query
def dedupe_spans(spark, sf):
    rows = clean_texts(spark, sf).select("id", detect.regex_spans(F.col("text")).alias("s"))
    doubled = F.concat("s", F.transform("s", lambda s: detect.span(s["start"] + 1, s["end"] + 1, s["label"], s["value"], s["source"], s["tier"], s["score"])))
    return spans_rows(rows.select("id", detect.dedupe_overlapping(doubled).alias("s")))


# Projections


@query
def parse_entities(spark, sf):
    return T.unnest(annotated(spark, sf), T.entities(F.col("text")), "e", "id").select("id", "e.start", "e.end", "e.label", "e.value")


@query
def parse_markers(spark, sf):
    return audit.occurrences(annotated(spark, sf)).select("id", F.col("pos").cast("long").alias("pos"), "start", "end", "value", "label")


@query
def strip_markers(spark, sf):
    return annotated(spark, sf).select("id", F.md5(T.strip_markers(F.col("text"))).alias("clean_md5"), F.md5(T.strip_markers(F.col("text"), rules.MARKER_V1)).alias("v1_md5"))


@query
def bio_words(spark, sf):
    rows = corpus.bio_rows(annotated(spark, sf).select("id", "text"))
    return T.unnest(rows, F.arrays_zip(F.col("tokens").alias("word"), F.col("tags").alias("tag")), "w", "id", at="pos").select("id", F.col("pos").cast("long").alias("pos"), "w.word", "w.tag")


@query
def shape_hashes(spark, sf):
    return annotated(spark, sf).select("id", T.shape_hash(F.col("text")).alias("shape")).union(table(spark, sf, "documents").select(-F.col("doc_id") - 1, T.shape_hash(F.col("text"))))


@query
def replace_entities(spark, sf):
    return annotated(spark, sf).select("id", T.replace_spans(T.strip_markers(F.col("text")), T.entities(F.col("text"))).alias("replaced"))


@query
def mask_and_name_values(spark, sf):
    return audit.occurrences(annotated(spark, sf)).select("id", F.col("pos").cast("long").alias("pos"), T.mask_value(F.col("value")).alias("masked"), T.pretty_label(F.concat(F.lit("B-"), F.col("label"))).alias("name"))


@query
def escape_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("escaped_md5"))


@query
def chunk_documents(spark, sf):
    return T.unnest(table(spark, sf, "documents"), T.chunks(F.col("text")), "c", "doc_id").select("doc_id", F.col("c.pos").cast("long").alias("pos"), F.md5("c.chunk").alias("chunk_md5"))


@query
def token_windows(spark, sf):
    docs = corpus.negative_rows(table(spark, sf, "documents").select("doc_id", "text"))
    w = T.unnest(docs, T.token_windows(F.col("tokens"), F.col("ner_tags")), "w", "doc_id")
    return w.select("doc_id", F.col("w.start").cast("long").alias("start"), F.size("w.tokens").cast("long").alias("n_tokens"), F.size("w.labels").cast("long").alias("n_labels"))


def piece_vocabulary(spark, sf):
    """Words of the benchmark texts, and their first and last one to four letters as pieces that begin or go on."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-zà-ɏ]+"), F.lit(0))).alias("w")).distinct()
    sizes = F.sequence(F.lit(1), F.lit(4))
    pieces = F.concat(F.array("w"), F.transform(sizes, lambda n: F.left("w", n)), F.transform(sizes, lambda n: F.concat(F.lit(wp.GLUE), F.right("w", n))))
    return wp.vocabulary(words.select(F.explode(pieces).alias("piece")))


@query
def document_pieces(spark, sf):
    """The pieces of every document, those of each position summed up."""
    docs = wp.encode(table(spark, sf, "documents").select("doc_id", "text"), piece_vocabulary(spark, sf), F.col("text")).drop("text")
    shown = F.array_join(F.transform("pieces", lambda p: F.concat_ws(":", p["piece"], p["id"].cast("string"), p["word"].cast("string"), p["start"].cast("string"), p["end"].cast("string"))), " ")
    unknown = F.size(F.filter("pieces", lambda p: p["id"] == wp.SPECIAL.index("[UNK]")))
    return docs.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), unknown.cast("long").alias("n_unknown"), F.md5(shown).alias("pieces_md5"))


@query
def piece_windows(spark, sf):
    """Training windows over the pieces of the marked texts' words, with their labels."""
    rows = corpus.bio_rows(annotated(spark, sf).select("id", "text"))
    cut = wp.encode(rows.select("id", "tokens", "ner_tags"), piece_vocabulary(spark, sf), words=F.col("tokens"))
    w = T.unnest(cut, wp.windows(F.col("pieces"), F.col("ner_tags"), 126, 32), "w", "id")
    joined = lambda c: F.md5(F.array_join(c, " "))
    return w.select("id", F.col("w.start").cast("long").alias("start"), F.size("w.input_ids").cast("long").alias("n_ids"), joined("w.input_ids").alias("ids_md5"), joined("w.labels").alias("labels_md5"), joined(F.transform("w.offsets", lambda o: F.concat_ws(":", o["start"].cast("string"), o["end"].cast("string")))).alias("offsets_md5"))


@query
def contract_outside_markers(spark, sf):
    return annotated(spark, sf).select("id", T.outside_markers(F.col("text"), T.contract).alias("text"))


@query
def split_tags(spark, sf):
    rows = corpus.bio_rows(annotated(spark, sf).select("id", "text"))
    tag = T.split_tag(F.col("tag"))
    return T.unnest(rows, "tags", "tag").groupBy(tag["prefix"].alias("prefix"), tag["label"].alias("label")).agg(F.count("*").alias("n"))


@query
def luhn_numbers(spark, sf):
    d = F.col("o_orderkey").cast("string")
    number = F.concat(F.lit("4111"), F.lpad(d, 12, "0"))
    return table(spark, sf, "orders").select("o_orderkey", T.luhn_valid(number).alias("valid"))


@query
def interface_scalars(spark, sf):
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(n, T.dismiss_ms(n).cast("long").alias("dismiss_ms"), T.cooldown_minutes(n * 7).cast("long").alias("minutes"))


@query
def external_to_bio(spark, sf):
    rows = annotated(spark, sf).select("id", T.strip_markers(F.col("text")).alias("source_text"), T.entities(F.col("text")).alias("e"))
    names = F.create_map(*[F.lit(x) for pair in {"CREDENTIAL": "PASSWORD", "EMAIL": "EMAIL", "PHONE": "TELEPHONENUM", "SSN": "SOCIALNUM", "CREDIT_CARD": "NAME"}.items() for x in pair])
    mask = F.transform("e", lambda e: F.struct(names[e["label"]].alias("label"), e["start"], e["end"], e["value"]))
    rows = rows.withColumn("privacy_mask", mask).where(corpus.has_target(F.col("privacy_mask")))
    return T.unnest(rows, corpus.external_bio(F.col("source_text"), F.col("privacy_mask")), "w", "id", at="pos").select("id", F.col("pos").cast("long").alias("pos"), "w.word", "w.tag")


# Audits


@query
def audit_structural(spark, sf):
    rows = annotated(spark, sf)
    return audit.structural(rows.where("split != 'neg'")).withColumn("negative_with_marker", F.lit(0).cast("long")).unionByName(audit.structural(rows.where("split = 'neg'"), False).withColumn("positive_without_marker", F.lit(0).cast("long")))


@query
def audit_semantic(spark, sf):
    return audit.semantic(annotated(spark, sf))


@query
def audit_variable_mismatches(spark, sf):
    return audit.variable_mismatches(annotated(spark, sf))


@query
def audit_diversity(spark, sf):
    rows = annotated(spark, sf)
    return audit.diversity(rows).crossJoin(audit.length_percentiles(rows))


@query
def audit_diversity_sketches(spark, sf):
    """Distinct shapes by split, and of all, exactly and from merged sketches, with whether four standard errors hold."""
    rows = annotated(spark, sf).select("id", "text", "split", F.pmod("id", F.lit(5)).alias("day"))
    sketches = audit.shape_sketches(rows, "split", "day")
    every = lambda df: df.withColumn("split", F.lit("all"))
    exact = lambda df: df.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct(T.shape_hash(F.col("text"))).alias("unique_shapes"))
    told = audit.merged_diversity(sketches, "split").union(audit.merged_diversity(every(sketches), "split"))
    both = exact(rows).union(exact(every(rows))).join(told.select("split", "unique_estimate"), "split")
    near = F.abs(F.col("unique_estimate") - F.col("unique_shapes")) <= F.greatest(F.lit(1.0), 4 * 0.0163 * F.col("unique_shapes"))
    return both.select("split", "rows", "unique_shapes", near.alias("estimate_is_near"))


@query
def audit_cube(spark, sf):
    return audit.occurrence_cube(annotated(spark, sf), "split", "category").select("split", "category", "label", F.col("level").cast("long").alias("level"), "n")


@query
def audit_top_repeats(spark, sf):
    return audit.top_repeats(annotated(spark, sf)).select("shape", F.col("count").alias("n"))


@query
def audit_coverage(spark, sf):
    return audit.coverage(annotated(spark, sf)).select("label", "n", F.round("actual_pct", 6).alias("actual_pct"), "expected_pct", F.round("deviation_pct", 6).alias("deviation_pct"), "within_tolerance")


@query
def audit_word_leaks(spark, sf):
    return audit.word_leaks(annotated(spark, sf)).select("id", "value")


@query
def audit_adjacent_labels(spark, sf):
    return audit.adjacent_labels(annotated(spark, sf)).select("id", F.col("pos").cast("long").alias("pos"), "label")


@query
def audit_cross_split(spark, sf):
    return audit.cross_split(annotated(spark, sf).select("split", "text"))


@query
def audit_prefix_overlap(spark, sf):
    rows = annotated(spark, sf)
    return audit.prefix_overlap(rows.where("split != 'neg'"), rows.where("split = 'neg'"))


@query
def audit_first_examples(spark, sf):
    return audit.first_examples(annotated(spark, sf), F.size(T.markers(F.col("text"))) == 0)


@query
def audit_token_sample(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return audit.tokenization(docs, lambda some: wp.encode(some, piece_vocabulary(spark, sf), F.col("text")).select(F.size("pieces").alias("n")))


@query
def benchmark_overlap(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return docs.join(items.select("text").distinct(), "text", "left_semi").select("doc_id")


@query
def benchmark_passages(spark, sf):
    return audit.shared_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# Splits and samples


def _strata(spark, sf):
    rows = annotated(spark, sf)
    return rows.select("id", "category", F.when(F.length("text") < 80, "short").when(F.length("text") < 150, "medium").otherwise("long").alias("length_mode"), F.pmod(F.col("id"), F.lit(3)).alias("context"))


@query
def stratified_split(spark, sf):
    return corpus.stratified_split(_strata(spark, sf), ["context", "length_mode", "category"]).select("id", "split")


@query
def bucket_counts(spark, sf):
    return corpus.bucket_counts(_strata(spark, sf), ["context", "length_mode", "category"]).withColumnRenamed("count", "n")


@query
def uncovered_buckets(spark, sf):
    rows = _strata(spark, sf).withColumn("split", F.when(F.col("id") % 97 == 0, "eval").otherwise("train"))
    return corpus.uncovered_buckets(rows, ["context", "length_mode", "category"]).withColumnRenamed("count", "n")


def _label_sets(spark, sf):
    return annotated(spark, sf).select("id", "split", F.array_sort(F.array_distinct(F.transform(T.entities(F.col("text")), lambda e: e["label"]))).alias("labels"))


@query
def rarest_label_split(spark, sf):
    return corpus.rarest_label_split(_label_sets(spark, sf)).select("id", "bucket", "split")


@query
def label_frequency(spark, sf):
    return evaluate.label_frequency(_label_sets(spark, sf)).withColumnRenamed("count", "n")


@query
def eval_share(spark, sf):
    return evaluate.eval_share(_label_sets(spark, sf)).select("label", "total", "in_eval", F.round("eval_pct", 6).alias("eval_pct"), "flag")


@query
def dense_ids(spark, sf):
    return corpus.dense_ids(table(spark, sf, "customer").select("c_name"), "c_name").select("id", "c_name")


@query
def keyed_sample(spark, sf):
    return corpus.keyed_sample(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), 12)


@query
def sample_each_source(spark, sf):
    return corpus.sample_each(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "source")


@query
def weighted_labels(spark, sf):
    u = synth.uniform("42", F.col("c_custkey"), "label")
    return table(spark, sf, "customer").select("c_custkey", corpus.weighted_choice(u, synth.LABEL_WEIGHTS).alias("label"))


@query
def language_filter(spark, sf):
    return table(spark, sf, "documents").where("lang = 'en'").groupBy("source").agg(F.count("*").alias("n"))


@query
def combined_corpus(spark, sf):
    rows = annotated(spark, sf).select("split", "text")
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("split"), "text")
    return corpus.combine(rows, docs).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"))


# Evaluation


def expected_and_predicted(spark, sf):
    """(id, category, expected, predicted): predictions are entities that are shifted, dropped or relabelled by draws."""
    rows = annotated(spark, sf).select("id", "category", T.entities(F.col("text")).alias("expected"))
    keep = F.filter("expected", lambda e: F.pmod(F.col("id") + e["start"], F.lit(7)) != 0)
    shift = (F.pmod(F.col("id"), F.lit(7)) - 3).cast("int")
    moved = F.transform(keep, lambda e: F.struct(F.greatest(e["start"] + shift, F.lit(0)).alias("start"), (e["end"] + shift).alias("end"), F.when(F.col("id") % 11 == 0, "EMAIL").otherwise(e["label"]).alias("label")))
    extra = F.when(F.col("id") % 13 == 0, F.array(F.struct(F.lit(100000).alias("start"), F.lit(100005).alias("end"), F.lit("SSN").alias("label")))).otherwise(F.array().cast("array<struct<start:int,end:int,label:string>>"))
    return rows.withColumn("predicted", F.concat(moved, extra))


@query
def robustness_scorecard(spark, sf):
    return evaluate.scorecard(expected_and_predicted(spark, sf)).withColumn("detect_pct", F.round("detect_pct", 6))


@query
def entity_f1(spark, sf):
    found = evaluate.entity_scores_of(expected_and_predicted(spark, sf), "expected", "predicted")
    return found.select("label", "expected", "predicted", "correct", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


#: Documented bound of the marked texts that the tagger of the queries is trained on.
TAGGER_ROWS = 3000
_TAGGERS: dict[tuple[str, str], crf.Weights] = {}


def tagged(spark, sf):
    """(id, category, expected, predicted): the texts whose checksum is even, and the spans that a tagger finds which is trained on
    the others. The class weights are those of the training texts' tags."""
    rows = annotated(spark, sf).withColumn("even", F.crc32(F.col("id").cast("string").cast("binary")) % 2 == 0)
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TAGGERS:
        some = corpus.keyed_sample(rows.where("not even").select("id", "text"), TAGGER_ROWS)
        weights = {r.label_id: r.weight for r in evaluate.class_weights(corpus.bio_rows(some), "ner_tags").collect()}
        _TAGGERS[key] = crf.train(crf.labelled(some), class_weights=weights)
    found = crf.predicted(crf.labelled(rows.where("even")), _TAGGERS[key])
    part = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))
    return found.select("id", "category", F.transform("entities", part).alias("expected"), F.transform("spans", part).alias("predicted"), "spans")


@query
def tagger_spans(spark, sf):
    return spans_rows(tagged(spark, sf).select("id", F.col("spans").alias("s"))).withColumn("score", F.round("score", 3))


@query
def tagger_entity_f1(spark, sf):
    found = evaluate.entity_scores_of(tagged(spark, sf), "expected", "predicted")
    return found.select("label", "expected", "predicted", "correct", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


@query
def tagger_scorecard(spark, sf):
    return evaluate.scorecard(tagged(spark, sf)).withColumn("detect_pct", F.round("detect_pct", 6))


def _tags(spark, sf):
    rows = corpus.bio_rows(annotated(spark, sf).select("id", "text"))
    return T.unnest(rows, "tags", "tag", "id", at="pos")


@query
def tag_entities(spark, sf):
    return evaluate.tag_entities(_tags(spark, sf)).select("id", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query
def class_weights(spark, sf):
    rows = corpus.bio_rows(annotated(spark, sf).select("id", "text"))
    return evaluate.class_weights(rows, "ner_tags").select(F.col("label_id").cast("long").alias("label_id"), F.round("weight", 9).alias("weight"))


@query
def tag_distribution(spark, sf):
    rows = corpus.bio_rows(annotated(spark, sf).select("id", "text"))
    return evaluate.tag_distribution(rows, limit=None).select(F.col("tag").cast("long").alias("tag"), F.col("count").alias("n"), F.round("pct", 6).alias("pct"))


@query
def scorecard_regression(spark, sf):
    rows = expected_and_predicted(spark, sf)
    new = evaluate.scorecard(rows)
    old = evaluate.scorecard(rows.where("id % 2 = 0 and category != 'SSN'"))
    return evaluate.compare_scorecards(old, new).select("category", F.round("new_pct", 6).alias("new_pct"), F.round("old_pct", 6).alias("old_pct"))


@query
def best_epoch(spark, sf):
    history = table(spark, sf, "nation").select(F.col("n_nationkey").alias("epoch"), (F.pmod(F.col("n_nationkey") * 7, F.lit(11)) / 11.0).alias("f1"))
    return evaluate.best_epoch(history).select("epoch")


# Synthesis


@query
def synth_values(spark, sf):
    key = F.col("n_nationkey")
    made = F.transform(synth.shape_table(list(synth.SHAPES)), lambda s: F.struct(s["name"].alias("shape"), synth.value_from(s["parts"], key, "42", s["name"]).alias("value")))
    return T.unnest(table(spark, sf, "nation"), made, "v", "n_nationkey").select("n_nationkey", "v.shape", "v.value")


@query
def synth_cards(spark, sf):
    card = synth.card_number(F.col("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", card.alias("card"), T.luhn_valid(F.regexp_replace(card, "[^0-9]", "")).alias("valid"))


@query
def synth_positives(spark, sf):
    return synth.positives(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


@query
def synth_negatives(spark, sf):
    return synth.negatives(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


@query
def synth_adversarial(spark, sf):
    return synth.adversarial(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


@query
def synth_corpus(spark, sf):
    return synth.corpus(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


@query
def synth_voices(spark, sf):
    rows = annotated(spark, sf)
    return rows.select("id", synth.voiced(F.col("text"), F.col("id")).alias("text"))


@query
def variable_names(spark, sf):
    rows = audit.occurrences(annotated(spark, sf))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), synth.variable_name(F.col("value"), F.col("label"), F.col("id")).alias("var"))


# Policy


@query
def site_lookup(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host")).withColumn("site", policy.site_of(F.col("host")))


@query
def effective_settings(spark, sf):
    stored = F.create_map(F.lit("blockBehavior"), F.when(F.col("n_nationkey") % 2 == 0, "inline-confirm").otherwise("modal"), F.lit("cooldownMinutes"), F.col("n_nationkey").cast("string"))
    site = F.when(F.col("n_regionkey") == 1, F.create_map(F.lit("enabled"), F.lit("false")))
    s = policy.effective_settings(stored, site)
    return table(spark, sf, "nation").select("n_nationkey", *[s[k].alias(k) for k in policy.DEFAULTS])


def paste_events(spark, sf):
    """(host, t, needs): events as pastes, some with something to block."""
    return table(spark, sf, "events").select(F.concat(F.lit("host"), F.pmod("user_id", F.lit(11)).cast("string")).alias("host"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), (F.pmod("event_id", F.lit(3)) == 0).alias("needs"), "event_id")


@query
def cooldown_sessions(spark, sf):
    found = policy.cooldown_rows(paste_events(spark, sf), 5)
    return found.groupBy("host").agg(F.count("*").alias("n"), F.count_if("silent").alias("silent"), F.count_if("prompt").alias("prompts"))


def _fails_on_sevenths():
    """A tagger that knows no words, and fails on texts whose length is a multiple of seven."""
    def tag(texts):
        if any(len(t) % 7 == 0 for t in texts):
            raise RuntimeError("seven")
        return [[] for _ in texts]

    return tag


@query
def failed_detection(spark, sf):
    """Documents of one chunk, masked by a tagger that fails on some, under each policy for those."""
    docs = table(spark, sf, "documents").where(F.length("text") <= rules.CHUNK).select("doc_id", "text")
    rows = detect.mask(detect.detect(docs, provider=detect.tagger(_fails_on_sevenths, "sevenths", guarded=True)))
    out = [F.md5(F.coalesce(policy.released(F.col("masked"), F.col("text"), F.col("error"), x), F.lit("held"))).alias(f"{x}_md5") for x in policy.FAILURES]
    return rows.select("doc_id", F.coalesce("error", F.lit("")).alias("error"), *out)


@query
def paste_decisions(spark, sf):
    rows = clean_texts(spark, sf)
    rows = detect.mask(detect.detect(rows))
    mode = F.element_at(F.array(*map(F.lit, ["confirm", rules.SILENT_MODE, rules.COOLDOWN_MODE, "modal"])), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    answer = F.element_at(F.array(*map(F.lit, rules.ANSWERS.values())), (F.pmod("id", F.lit(3)) + 1).cast("int"))
    out = policy.decide(mode, F.pmod("id", F.lit(5)) == 0, F.size(detect.of_tier(F.col("spans"), "block")) > 0, answer, F.col("text"), F.col("masked"))
    return rows.select("id", F.md5(out).alias("inserted_md5"), policy.shows_banner(F.col("spans"), F.lit("banner")).alias("banner"))


@query
def finding_chips(spark, sf):
    rows = clean_texts(spark, sf).select("id", policy.chips(detect.regex_spans(F.col("text"))).alias("c"))
    return rows.select("id", F.array_join(F.transform("c.shown", lambda x: F.concat_ws(":", x["label"], x["value"])), "; ").alias("shown"), F.col("c.more").cast("long").alias("more"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
