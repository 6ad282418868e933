"""A quality classifier by ordinal cumulative-link regression on hashed words.

Grades 0 < 1 < ... share one weight vector; ordered thresholds cut the score into grades:
P(grade >= k) = sigmoid(score - threshold_k). A text's score is the sum over its distinct words of the weights
of the word, its 4- and 5-character prefixes and its 3-character suffix, so every word has one number and
scoring is a lookup. The weights are fitted on the driver by follow-the-regularised-leader steps with an L1 penalty, over
a bounded sample of labelled rows (fit_rows, in hash order of the ids); every row of the input is scored whole.

Grades from the labels table: 0 for toxic, 1 for low quality, 2 for good. Rows are selected by the tail
probability of the top grade.

Defined results: null and empty texts score by the thresholds alone; without labelled rows, or with only
one grade among them, that grade's probability is even and all rows are kept; repeated ids in the labels
count once, with the lowest grade; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

BUCKETS = 1 << 20
#: Documented bound of the labelled sample, and of the words whose scores a worker remembers.
FIT_ROWS = 6_000
WORD_MEMORY = 300_000
#: Features in fewer sampled documents are left out.
MIN_DOCS = 4
#: Least P(top grade) of a selected row.
SELECT = 0.3


_MARKS = b"#*$%&|<>"


def word_features(word: bytes) -> list[int]:
    if word[0] == 0:
        return [zlib.crc32(word) % BUCKETS]
    text = word.decode("utf-8", "replace")
    parts = [b"w" + word, b"a" + text[:4].encode(), b"b" + text[:5].encode(), b"z" + text[-3:].encode()]
    return [zlib.crc32(p) % BUCKETS for p in parts]


def distinct_words(text: str | None) -> set[bytes]:
    """The words, and two words of our own, which start with a zero byte: how much of the text repeats
    words, and how much of it is marks."""
    if not text:
        return set()
    raw = text.encode("utf-8", "replace").lower().replace(b"\0", b" ")
    words = raw.split()
    out = set(words)
    if words:
        marks = (len(raw) - len(raw.translate(None, _MARKS))) / len(raw)
        out.add(b"\0r%d.%d" % (min(len(words).bit_length(), 14), 10 * len(out) // len(words)))
        out.add(b"\0m%d" % sum(marks > x for x in (0, 0.003, 0.01, 0.03, 0.1)))
    return out


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -40, 40)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l1: float = 8.0, l2: float = 1.0, rate: float = 0.05, epochs: int = 10, batch: int = 50) -> OrdinalModel:
    """rows: feature numbers of each document, repeats included."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    pair, times = np.unique(np.repeat(np.arange(len(rows)), sizes) * BUCKETS + flat, return_counts=True)
    common = np.bincount(pair % BUCKETS, minlength=BUCKETS) >= MIN_DOCS
    names = np.flatnonzero(common)
    keep = common[pair % BUCKETS]
    col, doc, times = np.searchsorted(names, pair[keep] % BUCKETS), pair[keep] // BUCKETS, times[keep].astype(np.float64)
    start = np.searchsorted(doc, np.arange(len(rows) + 1))
    share = np.array([np.mean(grades >= k) for k in range(1, n_grades)]).clip(1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log((1 - share) / share)) + 1e-3 * np.arange(n_grades - 1)
    # Rare grades count for more, by the root of their rarity.
    weight = np.sqrt(len(grades) / (n_grades * np.maximum(np.bincount(grades, minlength=n_grades), 1)))[grades]
    z, seen, seen_theta = np.zeros(len(names)), np.zeros(len(names)), np.ones(n_grades - 1)
    rng = np.random.default_rng(0)

    def solution() -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((1 + np.sqrt(seen)) / rate + l2)

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), batch):
            docs = order[k : k + batch]
            at = np.concatenate([np.arange(start[d], start[d + 1]) for d in docs])
            local = np.repeat(np.arange(len(docs)), start[docs + 1] - start[docs])
            w, y, i = solution(), grades[docs], np.arange(len(docs))
            s = np.bincount(local, w[col[at]] * times[at], len(docs))
            up = np.column_stack([np.ones(len(s)), _sigmoid(s[:, None] - theta), np.zeros(len(s))])
            hi, lo = up[i, y], up[i, y + 1]
            g = -weight[docs] * (1 - hi - lo)
            slope, p = up * (1 - up), np.maximum(hi - lo, 1e-6)
            by_theta = np.zeros_like(up)
            by_theta[i, y] += weight[docs] * slope[i, y] / p
            by_theta[i, y + 1] -= weight[docs] * slope[i, y + 1] / p
            gw = np.bincount(col[at], g[local] * times[at], len(names))
            z += gw - (np.sqrt(seen + gw * gw) - np.sqrt(seen)) / rate * w
            seen += gw * gw
            gt = by_theta[:, 1:-1].sum(0)
            seen_theta += gt * gt
            theta = np.maximum.accumulate(theta - rate * gt / np.sqrt(seen_theta))
    full = np.zeros(BUCKETS, np.float32)
    full[names] = solution()
    return OrdinalModel(full, theta)


def features(docs: DataFrame, id_col: str, text_col: str, extra: str) -> DataFrame:
    """(extra, features array<int>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                found = [[f for word in distinct_words(t.as_py()) for f in word_features(word)] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], [extra, "features"])

    return docs.select(F.col(extra).cast("int").alias(extra), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{extra} int, features array<int>")


def train(docs: DataFrame, graded: DataFrame, n_grades: int = 3, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> OrdinalModel | None:
    """graded (id, grade) joined to docs; the fit_rows rows of least id hash are used, whole."""
    grades = graded.where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    some = grades.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(fit_rows).select("id", "grade")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    got = features(texts, "id", "text", "grade").toArrow()
    y = got.column("grade").to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2:
        return None
    rows = got.column("features").combine_chunks()
    flat, cut = rows.flatten().to_numpy(), np.cumsum(rows.value_lengths().to_numpy())[:-1]
    return fit(np.split(flat, cut), y, n_grades)


def score(docs: DataFrame, model: OrdinalModel | None, n_grades: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, tails array<double>) for every row; tails[k-1] is P(grade >= k)."""
    spark = docs.sparkSession
    if model is None:
        even = F.array(*[F.lit((n_grades - k) / n_grades) for k in range(1, n_grades)])
        return docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0.0).alias("score"), even.alias("tails"))
    # 4 MB, whatever the input.
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column(1)):
                words = distinct_words(text.as_py())
                for word in words.difference(known):
                    known[word] = float(m.weights[word_features(word)].sum())
                scores[k] = sum(map(known.__getitem__, words))
                if len(known) > WORD_MEMORY:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(list(m.tails(scores)), pa.list_(pa.float64()))], ["id", "score", "tails"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double, tails array<double>")


def grades_of(labels: DataFrame) -> DataFrame:
    """0 toxic, 1 low quality, 2 good; rows with neither label are left out."""
    return labels.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).cast("int").alias("grade"))


def op5_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade, tail probabilities and selection."""
    docs = documents(spark, sf_dir)
    model = train(docs, grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    found = score(docs, model)
    one, two = F.element_at("tails", 1), F.element_at("tails", 2)
    kept = two >= SELECT if model is not None else F.lit(True)
    return found.select(F.col("id").alias("doc_id"), "score", (one + two).alias("expected_grade"), one.alias("p_not_toxic"), two.alias("p_good"), kept.alias("kept"))
