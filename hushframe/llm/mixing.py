"""Mixing to target weights with soft domain membership.

A classifier learnt from labelled rows gives every document a posterior over the domains. Document i has n_i
tokens and posterior p_i; at rates r_i the expected tokens of domain k are sum_i r_i n_i p_ik. Rates are fitted
by projected-gradient least squares: they start at 1, each step moves all rates along the gradient of the
squared misses, scaled by the inverse of its curvature over the domains and the rates that are free to move, and
clips them at `floor`, by default 0. Where clipping makes such a step useless, the plain gradient is taken. One step
is one distributed sum of some dozen numbers; a document's rate follows from its own posterior and the few multipliers
so far, so rates are never shuffled or stored between steps. Steps end where the targets are met to `tolerance`, or
where rates come no nearer, ten steps together by less than a hundredth of the squared misses: targets that are out of
reach get such rates, and the report has the miss. If the sums run out before, that is an error.

The classifier is multinomial naive Bayes over hashed words, from a bounded sample (fit_rows labelled rows, by
least id hash); posteriors and token counts read every whole text. Unless a total is given, the targets add up to
the tokens there are. With a floor above 0, that total may be out of reach; `reachable_total` gives one that is
not: at the rates it stands for, no document is below the floor, so mixing repeats documents and drops none.

In the tables here a text says nothing about its source column, so a classifier of sources could only give
the prior; the query's domains are the languages, of the documents that the labels table covers.

Defined results: null and empty texts have no tokens, the prior as posterior and rate 1; rows of a domain
that is not in the targets train nothing; without labelled rows all posteriors are even, and so rates stay as they
are; targets without any tokens to meet them leave all rates at 1; an empty table gives an empty result; repeated rows
get equal rates; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, documents, materialize, with_release

BUCKETS = 1 << 18
#: Documented bounds: labelled rows that are learnt from, and words whose bucket a worker remembers.
FIT_ROWS = 4_000
WORD_MEMORY = 300_000
#: Targets of the registered query and of the pipeline.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
ROUNDS = 200
#: Steps that are looked back on to tell whether rates still come nearer.
STALLED = 10


def word_buckets(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    words = text.encode("utf-8", "replace").lower().split() if text else []
    for w in set(words).difference(known):
        known[w] = zlib.crc32(w) % BUCKETS
    out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    if len(known) > WORD_MEMORY:
        known.clear()
    return out


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], text_col: str = "text", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """labelled (id, domain) -> log-weights (BUCKETS + 1, domains); the last row is the log-prior."""
    some = labelled.where(F.col("id").isNotNull() & F.col("domain").isin(domains)).groupBy("id").agg(F.min("domain").alias("domain"))
    some = some.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "id").select("domain", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        counts, rows = np.zeros((len(domains), BUCKETS), np.int64), np.zeros(len(domains), np.int64)
        for batch in batches:
            for domain, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                k = domains.index(domain)
                counts[k] += np.bincount(word_buckets(text.as_py(), known), minlength=BUCKETS)
                rows[k] += 1
        k, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, np.arange(len(domains)))), pa.array(np.append(b, np.full(len(domains), -1))), pa.array(np.append(counts[k, b], rows))], ["k", "b", "n"])

    # At most domains x BUCKETS sums, whatever the input.
    sums = texts.mapInArrow(with_release(run), "k long, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    k, b, n = (sums.column(c).to_numpy() for c in ("k", "b", "n"))
    counts, rows = np.zeros((BUCKETS, len(domains))), np.zeros(len(domains))
    rows[k[b < 0]] = n[b < 0]
    counts[b[b >= 0], k[b >= 0]] = n[b >= 0]
    smooth = counts + 0.1
    prior = (rows + 1) / (rows + 1).sum()
    return np.vstack([np.log(smooth / smooth.sum(axis=0)), np.log(prior)]).astype(np.float32)


def members(docs: DataFrame, weights: np.ndarray, text_col: str = "text", id_col: str = "doc_id", temperature: float = 1.0) -> DataFrame:
    """(id, n_tokens, p array<double>) for every row. The word evidence is divided by the root of the number
    of words, since words of a text are far from independent, and tempered."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            n, p = posteriors((t.as_py() for t in batch.column(1)), shared.value, known, temperature)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["id", "n_tokens", "p"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(with_release(run), "id long, n_tokens long, p array<double>")


def posteriors(texts: Iterable[str | None], w: np.ndarray, known: dict[bytes, int], temperature: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(words, posterior over the domains) of each text."""
    n, s = [], []
    for text in texts:
        b = word_buckets(text, known)
        score = w[-1].astype(np.float64)
        if len(b):
            e = w[b].sum(axis=0, dtype=np.float64)
            score = score + (e - e.mean()) / math.sqrt(len(b)) / temperature
        n.append(len(b))
        s.append(score)
    p = np.array(s, np.float64).reshape(-1, w.shape[1])
    p = np.exp(p - p.max(axis=1, keepdims=True))
    return np.array(n, np.int64), p / p.sum(axis=1, keepdims=True)


def _rate(p: F.Column, history: list[np.ndarray], floor: float) -> F.Column:
    """The rate after the steps so far: each adds its multipliers' product with p, and clips at the floor."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in history])
    return F.aggregate(steps, F.lit(1.0), lambda r, step: F.greatest(F.lit(float(floor)), r + F.aggregate(F.zip_with(p, step, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


def fit_rates(found: DataFrame, domains: list[str], targets: dict[str, float], total: float | None = None, floor: float = 0.0, rounds: int = ROUNDS, tolerance: float = 1e-6) -> tuple[F.Column, dict]:
    """found (id, n_tokens, p) -> (rate as a function of column p, report).

    Every step asks for the expected tokens of each domain at the present rates, and for their curvature over the
    documents whose rate is above the floor. The gradient in r_i of half the squared misses is n_i sum_k p_ik
    miss_k; it is preconditioned by n_i, so that long texts do not move first, and by that curvature. A step is cut
    in half until it brings the squared misses down; where none does, the gradient itself is taken, which does so
    anywhere but at the closest rates. RuntimeError: `rounds` sums were enough neither for `tolerance`, relative to
    the greatest target, nor to come to a stop."""
    if floor < 0 or floor > 1:
        raise ValueError("floor must be from 0 to 1, the rate at the start")
    share = np.array([targets[d] for d in domains], float)
    share = share / share.sum()
    kth = [F.col("p")[k] for k in range(len(domains))]

    def sums(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rate = _rate(F.col("p"), history, floor)
        rows = found.select("n_tokens", "p", rate.alias("r"))
        # At the start, rates at the floor are free as well: they may rise.
        free = F.when((F.col("r") > floor) | F.lit(not history), F.col("n_tokens")).otherwise(0)
        cells = [F.sum(F.col("n_tokens") * F.col("r") * x) for x in kth] + [F.sum(free * x * y) for x in kth for y in kth]
        got = np.array([float(v or 0.0) for v in rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()])
        return got[: len(domains)], got[len(domains) :].reshape(len(domains), -1)

    now, gram = sums([])
    if not now.sum():
        return F.lit(1.0), {"before": now.tolist(), "after": now.tolist(), "target": now.tolist(), "steps": 0, "history": []}
    target = share * (total if total is not None else now.sum())
    history: list[np.ndarray] = []
    before, asked = now, 0

    def better(step: np.ndarray, halves: int) -> bool:
        """Take the first of step, its half, ... that brings the squared misses down by more than rounding."""
        nonlocal history, now, gram, asked
        worst = ((target - now) ** 2).sum()
        for half in range(halves):
            if asked >= rounds:
                raise RuntimeError(f"rates miss the targets by {np.abs(target - now).max() / target.max():.2e} after {asked} sums")
            after, curve = sums([*history, step * 0.5**half])
            asked += 1
            if ((target - after) ** 2).sum() < worst * (1 - 1e-9):
                history, now, gram = [*history, step * 0.5**half], after, curve
                return True
        return False

    trail = [((target - now) ** 2).sum()]
    while np.abs(target - now).max() > tolerance * target.max():
        if len(trail) > STALLED and trail[-1] > 0.99 * trail[-1 - STALLED]:
            break
        miss = target - now
        newton = np.linalg.pinv(gram, rcond=1e-9) @ miss
        if np.abs(newton).max() > 0 and better(newton, 4):
            trail.append(((target - now) ** 2).sum())
            continue
        # No curvature of free rates at all: a step that moves the mean rate by one is a start.
        scale = np.linalg.norm(gram, 2) or np.abs(target - now).max()
        if not better(miss / scale, 12):
            break
        trail.append(((target - now) ** 2).sum())
    return _rate(F.col("p"), history, floor), {"before": before.tolist(), "after": now.tolist(), "target": target.tolist(), "steps": len(history), "history": history}


def reachable_total(found: DataFrame, domains: list[str], targets: dict[str, float], slack: float = 1.05, most: float = 20.0) -> float:
    """A total at which rates of 1 and more meet the targets: rates are 1 + sum_k p_ik x_k, with x not negative. Where
    the shortfall at the scale of the best supplied domain needs a negative x, the scale grows. Targets that would need more
    than `most` times the tokens there are, or that no rates meet, get the total there is."""
    kth = [F.col("p")[k] for k in range(len(domains))]
    row = found.agg(*[F.sum(F.col("n_tokens") * x) for x in kth], *[F.sum(F.col("n_tokens") * x * y) for x in kth for y in kth]).first()
    got = np.array([float(v or 0.0) for v in row])
    now, gram = got[: len(domains)], got[len(domains) :].reshape(len(domains), -1)
    share = np.array([targets[d] for d in domains], float)
    share = share / share.sum()
    if not now.sum() or not (now[share > 0] > 0).all():
        return float(now.sum())
    total, inverse = float((now[share > 0] / share[share > 0]).max()), np.linalg.pinv(gram, rcond=1e-9)
    while total <= most * now.sum():
        short = share * total - now
        x = inverse @ short
        if (x >= -1e-9 * np.abs(x).max()).all() and np.abs(gram @ x - short).max() <= 1e-6 * total:
            return total
        total *= slack
    return float(now.sum())


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", floor: float = 0.0, total: float | None = None, **options) -> tuple[DataFrame, dict]:
    """(id, n_tokens, p, rate) for every row, and the report of the fit. With a floor above 0 and no total, a total
    that the floor allows is taken."""
    domains = sorted(targets)
    weights = train(docs, labelled, domains, text_col, id_col)
    found = materialize(members(docs, weights, text_col, id_col), "members")
    if floor > 0 and total is None:
        total = reachable_total(found, domains, targets)
    rate, report = fit_rates(found, domains, targets, total=total, floor=floor, **options)
    return found.withColumn("rate", F.when(F.col("n_tokens") > 0, rate).otherwise(1.0)), report | {"weights": weights, "floor": floor}


def repeat_rows(docs: DataFrame, report: dict, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with every row as often as its rate says; columns as they are. Rates are computed again from the
    texts, so no row is joined to its rate. The broken part of a rate is drawn by a hash of the id and the text, so
    equal texts draw apart; rows with no id draw by their text."""
    shared = docs.sparkSession.sparkContext.broadcast((report["weights"], report["history"], report["floor"]))
    at, name = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, history, floor = shared.value
        known: dict[bytes, int] = {}
        for part in byte_slices(batches, at):
            texts = [t.as_py() or "" for t in part.column(at)]
            n, p = posteriors(texts, weights, known)
            r = np.ones(len(texts))
            for step in history:
                r = np.maximum(floor, r + p @ step)
            r[n == 0] = 1
            keys = [f"{i}|{t}" for i, t in zip(part.column(name).to_pylist(), texts)]
            u = np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "replace"), 9) for k in keys], np.float64) / 2.0**64
            times = np.floor(r).astype(np.int64) + (u < r - np.floor(r))
            yield part.take(pa.array(np.repeat(np.arange(len(texts)), times)))

    return docs.mapInArrow(with_release(run), docs.schema)


def copies(rate: F.Column, *keys: F.Column) -> F.Column:
    """A whole number of copies whose mean over keys is the rate, by a hash of the keys, nulls among them."""
    u = F.pmod(F.xxhash64(*[F.coalesce(k.cast("string"), F.lit("")) for k in keys]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def labelled_domains(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", domain_col: str = "lang") -> DataFrame:
    """(id, domain) of the documents that the labels table covers; of all documents where there is none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(domain_col).alias("domain"))
    return rows if labels is None else rows.join(labels.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")


def op9_mixing_soft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, domain posteriors, rate and copies, with the achieved and the target totals."""
    docs = documents(spark, sf_dir)
    found, report = mix(docs, labelled_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)
    domains = sorted(TARGETS)
    p = [F.element_at("p", k + 1).alias(f"p_{d}") for k, d in enumerate(domains)]
    miss = max(abs(a - t) / t if t else 0.0 for a, t in zip(report["after"], report["target"]))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", *p, "rate", copies(F.col("rate"), F.col("id"), F.col("n_tokens")).alias("copies"), F.lit(miss).alias("largest_miss"))
