"""A token tagger that is trained here: a linear-chain conditional random field over hashed features.

Texts are cut into pieces (runs of letters and digits, and single other characters), each with features of itself, its
neighbours and its shape. Training is full-batch: in every step each task runs the forward-backward recursion over its
texts, side by side, and sends its gradient as a few blocks of numbers; their sums, of a size that does not depend on
the data, go to the driver, which moves the weights (L-BFGS) and sends them out again. Decoding is Viterbi; a piece's
score is the probability of its label given the text.

Texts may be weighted by the mean of their labels' class weights, so rare labels count for more.

Defined results: null and empty texts have no pieces; rows without entities train the outside label; without any rows all
weights are 0 and every piece is outside; equal paths go to the smaller label; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.shared import settled
from . import detect

#: Hashed features: a bound of the model's size, 2**16 rows of weights.
BUCKETS = 1 << 16
#: Weights go to and fro in blocks of so many rows.
BLOCK = 1 << 12
#: Texts whose recursions run side by side.
LANES = 512
STEPS, DECAY = 40, 2e-3
#: Steps that the estimate of the curvature remembers.
MEMORY = 8
PIECE = re.compile(r"[^\W_]+|[^\w\s]|_")
N = len(rules.BIO)


def pieces(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, piece) of a text, in code points."""
    return [(m.start(), m.end(), m[0]) for m in PIECE.finditer(text or "")]


def gold(text: str | None, entities: list[tuple[int, int, str]]) -> list[int]:
    """Label ids of the pieces: the first piece of an entity is B, others inside it are I."""
    ids = {tag: k for k, tag in enumerate(rules.BIO)}
    out, at, spans = [], 0, sorted(entities)
    opened = -1
    for start, _, _ in pieces(text):
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        if at < len(spans) and spans[at][0] <= start:
            out.append(ids[("I-" if opened == at else "B-") + spans[at][2]])
            opened = at
        else:
            out.append(0)
    return out


def _shape(w: str) -> str:
    kind = "".join("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in w[:40])
    return re.sub(r"(.)\1{3,}", lambda m: m[1] * 4, kind)


def _own(w: str) -> tuple[str, ...]:
    low = w.lower()
    size = str(len(w)) if len(w) < 6 else "6" if len(w) < 10 else "10" if len(w) < 16 else "16" if len(w) < 30 else "30"
    mixed = f"{any(c.isdigit() for c in w):d}{any(c.isupper() for c in w):d}{any(c.islower() for c in w):d}"
    return low[:24], _shape(w), low[:3], low[-3:], size + mixed


#: What a worker remembers of pieces, before it begins anew.
_MEMORY = 200_000


class Features:
    """Numbers of the features of each piece: of itself, of two neighbours on each side, and of pairs of them."""

    width = 19

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, ...]] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        edge = ("", "", "", "", "")
        if len(self.known) > _MEMORY:
            self.known.clear()
        for w in words:
            if w not in self.known:
                self.known[w] = _own(w)
        own = [edge, edge, *(self.known[w] for w in words), edge, edge]
        out = np.empty((len(words), self.width), np.int32)
        for i in range(len(words)):
            b2, b1, me, a1, a2 = own[i : i + 5]
            found = (
                "0", "w" + me[0], "s" + me[1], "p" + me[2], "e" + me[3], "k" + me[4], "v" + b1[0], "t" + b1[1], "n" + a1[0], "u" + a1[1], "x" + b2[0], "y" + a2[0],
                "a" + b1[0] + " " + me[1], "b" + me[1] + " " + a1[1], "c" + b1[1] + " " + me[1], "d" + b2[1] + " " + b1[1] + " " + me[1], "f" + b1[0] + " " + me[0], "g" + b2[0] + " " + b1[0] + " " + me[4], "h" + me[1] + " " + a1[1] + " " + a2[1],
            )
            out[i] = [zlib.crc32(f.encode("utf-8", "replace")) % BUCKETS for f in found]
        return out


@dataclass
class Weights:
    """Scores of (feature, label), of (label before, label), and of the first label."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray

    @staticmethod
    def none() -> Weights:
        return Weights(np.zeros((BUCKETS, N)), np.zeros((N, N)), np.zeros(N))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.emit.ravel(), self.step.ravel(), self.first])

    @staticmethod
    def of(flat: np.ndarray) -> Weights:
        a, b = BUCKETS * N, BUCKETS * N + N * N
        return Weights(flat[:a].reshape(BUCKETS, N), flat[a:b].reshape(N, N), flat[b:])


def side_by_side(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of sequences, longest first, in groups that run together."""
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    for k in range(0, len(order), LANES):
        yield order[k : k + LANES]


def _laid_out(scores: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, lanes, N) scores of sequences in falling order of size, and the number of lanes that run at each step."""
    out = np.zeros((sizes[0], len(sizes), N))
    for lane, (b, n) in enumerate(zip(begins.tolist(), sizes.tolist())):
        out[:n, lane] = scores[b : b + n]
    return out, (sizes[None, :] > np.arange(sizes[0])[:, None]).sum(axis=1)


def marginals(scores: np.ndarray, live: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the sum over paths by lane, probability of each label at each step, factors for pairs): forward-backward."""
    steps, lanes, _ = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e = np.exp(scores - top)
    move, begin = np.exp(w.step), np.exp(w.first)
    alpha, scale = np.zeros_like(e), np.ones((steps, lanes))
    alpha[0] = e[0] * begin
    for t in range(steps):
        n = live[t]
        if t:
            alpha[t, :n] = (alpha[t - 1, :n] @ move) * e[t, :n]
        scale[t, :n] = alpha[t, :n].sum(axis=1)
        alpha[t, :n] /= scale[t, :n, None]
    beta, pairs = np.ones_like(e), np.zeros_like(e)
    for t in range(steps - 1, 0, -1):
        n = live[t]
        # What a label at t and all that follows weigh, as the pair before it needs it.
        pairs[t, :n] = e[t, :n] * beta[t, :n] / scale[t, :n, None]
        beta[t - 1, :n] = pairs[t, :n] @ move.T
    running = np.arange(lanes)[None, :] < live[:, None]
    total = (np.log(scale) + np.where(running, top[:, :, 0], 0)).sum(axis=0)
    return total, alpha * beta, (alpha, pairs)


def gradient(features: np.ndarray, labels: np.ndarray, begins: np.ndarray, sizes: np.ndarray, weight: np.ndarray, w: Weights) -> tuple[float, np.ndarray]:
    """(weighted log-likelihood, its gradient) of the sequences of one batch."""
    scores = w.emit[features].sum(axis=1) if len(features) else np.zeros((0, N))
    value, emit, step, first = 0.0, np.zeros((BUCKETS, N)), np.zeros((N, N)), np.zeros(N)
    move = np.exp(w.step)
    for group in side_by_side(sizes):
        b, n, v = begins[group], sizes[group], weight[group]
        laid, live = _laid_out(scores, b, n)
        total, p, (alpha, pairs) = marginals(laid, live, w)
        value -= float((v * total).sum())
        for t in range(1, len(live)):
            k = live[t]
            step -= move * ((alpha[t - 1, :k] * v[:k, None]).T @ pairs[t, :k])
        first -= (p[0] * v[:, None]).sum(axis=0)
        at = np.concatenate([np.arange(x, x + y) for x, y in zip(b.tolist(), n.tolist())])
        off = -np.concatenate([p[:y, lane] for lane, y in enumerate(n.tolist())])
        mine = labels[at]
        off[np.arange(len(at)), mine] += 1
        own = np.repeat(v, n)
        value += float((own * scores[at, mine]).sum())
        inner = np.ones(len(at), bool)
        heads = np.concatenate(([0], np.cumsum(n)[:-1]))
        inner[heads] = False
        inner = np.flatnonzero(inner)
        np.add.at(step, (mine[inner - 1], mine[inner]), own[inner])
        value += float((own[inner] * w.step[mine[inner - 1], mine[inner]]).sum())
        np.add.at(first, mine[heads], v)
        value += float((v * w.first[mine[heads]]).sum())
        off *= own[:, None]
        cells = features[at].ravel()
        for label in range(N):
            emit[:, label] += np.bincount(cells, np.repeat(off[:, label], features.shape[1]), BUCKETS)
    return value, np.concatenate([emit.ravel(), step.ravel(), first])


def viterbi(scores: np.ndarray, live: np.ndarray, w: Weights) -> np.ndarray:
    """The best label at each step of each lane."""
    steps, lanes, _ = scores.shape
    best, back = scores[0] + w.first, np.zeros((steps, lanes, N), np.int64)
    last = np.zeros((lanes, N))
    for t in range(1, steps):
        n = live[t]
        last[n : live[t - 1]] = best[n : live[t - 1]]
        reach = best[:n, :, None] + w.step
        back[t, :n] = reach.argmax(axis=1)
        best = reach.max(axis=1) + scores[t, :n]
    last[: live[-1]] = best[: live[-1]]
    out = np.zeros((steps, lanes), np.int64)
    now, sizes = last.argmax(axis=1), (np.arange(lanes)[None, :] < live[:, None]).sum(axis=0)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        ends = sizes[:n] - 1 == t
        now[:n] = np.where(ends, last[:n].argmax(axis=1), now[:n])
        out[t, :n] = now[:n]
        now[:n] = back[t, np.arange(n), now[:n]]
    return out


class Tagger:
    """Tags texts by given weights."""

    def __init__(self, w: Weights):
        self.w, self.features = w, Features()

    def __call__(self, texts: list[str]) -> list[list[dict]]:
        cut = [pieces(t) for t in texts]
        sizes = np.array([len(c) for c in cut], np.int64)
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
        found: list[list[dict]] = [[] for _ in texts]
        for group in side_by_side(sizes):
            scores = [self.w.emit[self.features([p[2] for p in cut[i]])].sum(axis=1) for i in group]
            n = sizes[group]
            laid, live = _laid_out(np.concatenate(scores), np.concatenate(([0], np.cumsum(n)[:-1])), n)
            path = viterbi(laid, live, self.w)
            p = marginals(laid, live, self.w)[1]
            for lane, i in enumerate(group.tolist()):
                for t in np.flatnonzero(path[: n[lane], lane]).tolist():
                    label = int(path[t, lane])
                    found[i].append({"entity": rules.BIO[label], "score": float(min(1.0, p[t, lane, label])), "index": t, "word": cut[i][t][2].lower()})
        return found


def examples(rows: DataFrame, text_col: str = "text", entities_col: str = "entities", weights: dict[int, float] | None = None) -> DataFrame:
    """Texts with their entities -> (features, labels, weight) of each text, as a tagger reads them."""
    share = np.array([(weights or {}).get(k, 1.0) for k in range(N)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            out = []
            for text, entities in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                labels = gold(text, [(e["start"], e["end"], e["label"]) for e in entities or []])
                x = features([p[2] for p in pieces(text)])
                out.append((x.ravel(), labels, float(share[labels].mean()) if labels else 1.0))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.float64())], ["features", "labels", "weight"])

    entities = F.transform(F.col(entities_col), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label")))
    return rows.select(F.col(text_col).cast("string").alias("text"), entities.alias("entities")).mapInArrow(run, "features array<int>, labels array<int>, weight double")


def likelihood(rows: DataFrame, w: Weights) -> tuple[float, np.ndarray, int]:
    """(weighted log-likelihood, gradient, texts) over all examples, summed by blocks."""
    shared = rows.sparkSession.sparkContext.broadcast(w.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value, total, texts = Weights.of(shared.value), 0.0, np.zeros(len(shared.value)), 0
        for batch in batches:
            labels = batch.column(1)
            sizes = np.diff(labels.offsets.to_numpy()).astype(np.int64)
            begins = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
            # flatten() leaves out what lies outside a slice.
            features = batch.column(0).flatten().to_numpy().reshape(-1, Features.width)
            v, g = gradient(features, labels.flatten().to_numpy(), begins, sizes, batch.column(2).to_numpy(), now)
            value, total, texts = value + v, total + g, texts + batch.num_rows
        cut = [total[k : k + BLOCK * N] for k in range(0, len(total), BLOCK * N)] if texts else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary()), pa.array([value] * len(cut)), pa.array([texts] * len(cut), pa.int64())], ["block", "sums", "value", "texts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in table.column("sums")], axis=0)
        return pa.table({"block": table.column("block")[:1], "sums": pa.array([total.tobytes()]), "value": [sum(table.column("value").to_pylist())], "texts": [sum(table.column("texts").to_pylist())]})

    schema = "block int, sums binary, value double, texts long"
    # A row for each block of weights, whatever the number of texts.
    sums = rows.mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).toArrow().combine_chunks().sort_by("block")
    if not sums.num_rows:
        return 0.0, np.zeros(len(w.flat())), 0
    return sums.column("value")[0].as_py(), np.concatenate([np.frombuffer(x.as_py()) for x in sums.column("sums")]), sums.column("texts")[0].as_py()


def _direction(g: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse curvature that the last steps (move, change of the gradient) tell of."""
    q, kept = g.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (y @ s)
        q -= a * y
        kept.append(a)
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(kept)):
        q += (a - (y @ q) / (y @ s)) * s
    return q


def train(rows: DataFrame, text_col: str = "text", entities_col: str = "entities", class_weights: dict[int, float] | None = None, steps: int = STEPS, decay: float = DECAY) -> Weights:
    """Fit a tagger to texts and their entities: the mean log-likelihood of a text, less decay / 2 times the squared weights,
    is raised until `steps` sums over the texts are used up. Examples are written once and read for every sum."""
    kept = settled(examples(rows, text_col, entities_col, class_weights), "examples")

    def value_at(x: np.ndarray) -> tuple[float, np.ndarray, int]:
        value, g, texts = likelihood(kept, Weights.of(x))
        n = max(texts, 1)
        return decay / 2 * float(x @ x) - value / n, decay * x - g / n, texts

    x, past = Weights.none().flat(), []
    value, g, texts = value_at(x)
    if not texts:
        return Weights.of(x)
    length = 1.0 / max(float(np.linalg.norm(g)), 1e-12)
    for _ in range(steps - 1):
        move = -length * _direction(g, past)
        after, slope, _ = value_at(x + move)
        if after > value + 1e-4 * float(g @ move):
            # Too far: try less, at last along the gradient itself.
            length, past = length / 4, [] if length < 0.05 else past
            continue
        if (slope - g) @ move > 1e-12:
            past = [*past[-MEMORY + 1 :], (move, slope - g)]
        x, value, g, length = x + move, after, slope, 1.0
        if float(np.abs(g).max()) < 1e-5:
            break
    return Weights.of(x)


def save(spark, w: Weights, path: str) -> None:
    """The weights that are not 0, as a Parquet table."""
    flat = w.flat().astype(np.float32)
    at = np.flatnonzero(flat)
    spark.createDataFrame(pa.table({"at": at, "weight": flat[at]})).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Weights:
    """At most as many rows as the model has weights."""
    table, flat = spark.read.parquet(path).toArrow(), np.zeros(len(Weights.none().flat()))
    flat[table.column("at").to_numpy()] = table.column("weight").to_numpy()
    return Weights.of(flat)


def provider(spark, w: Weights, guarded: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A provider for detect.detect(): the weights go to the workers once, and are unpacked once in each."""
    shared = spark.sparkContext.broadcast(w.flat().astype(np.float32))
    return detect.tagger(lambda: Tagger(Weights.of(shared.value.astype(np.float64))), f"crf-{uuid.uuid4().hex}", guarded)


def predicted(rows: DataFrame, w: Weights, text_col: str = "text", policy: str = "shipped") -> DataFrame:
    """rows with `spans`, of the tagger and the catalogue."""
    return detect.detect(rows, text_col, provider(rows.sparkSession, w), policy=policy)


def labelled(marked: DataFrame, text_col: str = "text") -> DataFrame:
    """Marked texts -> their columns with text_col clean, and the `entities` that have any text beside it."""
    return marked.withColumn("entities", F.filter(T.entities(F.col(text_col)), lambda e: e["end"] > e["start"])).withColumn(text_col, T.strip_markers(F.col(text_col)))
