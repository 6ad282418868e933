"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into windows of bytes; a forward and a backward network read each window, every byte position
gets a distribution over the languages, and a document's score pools the log-probabilities of all its
positions. Training is backpropagation through time with Adam on the driver, over a bounded sample
(fit_rows documents in hash order of the ids, balanced over the languages); prediction reads every byte of
every text, many windows side by side. A byte's share of the gates comes from a table with a row for each
byte value, so only the recurrent part is a matrix product.

Defined results: texts that are null or have no letter are `und` with score 0, and so are all texts if
nothing can be learnt from; repeated rows get equal results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, documents

#: Documented bound of the training sample: documents for each language.
FIT_ROWS = 250
WINDOW = 96
HIDDEN = 16
_LANES = 2048
_LETTER = regex.compile(r"\p{L}")


class Direction:
    """One gated recurrent layer: z and r gates and a candidate, side by side in each matrix."""

    names = ("table", "inner", "candidate")

    def __init__(self, rng: np.random.Generator | None = None, hidden: int = HIDDEN):
        if rng is not None:
            self.table = (0.3 * rng.standard_normal((257, 3 * hidden))).astype(np.float32)
            self.inner = (rng.standard_normal((hidden, 2 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.candidate = (rng.standard_normal((hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)

    def run(self, x: np.ndarray, keep: bool = False):
        """x: (steps, lanes) of byte numbers, 256 past the end -> states (steps, lanes, hidden)."""
        steps, lanes = x.shape
        H = self.candidate.shape[0]
        h = np.zeros((lanes, H), np.float32)
        out = np.empty((steps, lanes, H), np.float32)
        kept = []
        # Buffers of their own, and gates with the sign that exp() needs: fresh arrays of this size cost more than the sums.
        x, gates = x.astype(np.intp), -self.inner
        a, g, rh, c = (np.empty((lanes, k * H), np.float32) for k in (3, 2, 1, 1))
        z, r = g[:, :H], g[:, H:]
        for t in range(steps):
            np.take(self.table, x[t], axis=0, out=a, mode="clip")
            np.matmul(h, gates, out=g)
            g -= a[:, : 2 * H]
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(r, h, out=rh)
            np.matmul(rh, self.candidate, out=c)
            c += a[:, 2 * H :]
            np.tanh(c, out=c)
            if keep:
                kept.append((h, z.copy(), r.copy(), c.copy()))
            new = out[t]
            np.subtract(c, h, out=new)
            new *= z
            new += h
            h = new
        return (out, kept) if keep else out

    def back(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients from those of the states, through time."""
        H = self.candidate.shape[0]
        grads = {k: np.zeros_like(getattr(self, k)) for k in self.names}
        dh = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = kept[t]
            dh = dh + d_out[t]
            dz = dh * (c - h) * z * (1 - z)
            dc = dh * z * (1 - c * c)
            drh = dc @ self.candidate.T
            dr = drh * h * r * (1 - r)
            da = np.concatenate([dz, dr, dc], axis=1)
            np.add.at(grads["table"], x[t], da)
            grads["inner"] += h.T @ da[:, : 2 * H]
            grads["candidate"] += (r * h).T @ dc
            dh = dh * (1 - z) + drh * r + da[:, : 2 * H] @ self.inner.T
        return grads


class ByteTagger:
    """Both directions and the output layer over their joined states."""

    def __init__(self, languages: list[str], seed: int = 0, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forward, self.backward = Direction(rng, hidden), Direction(rng, hidden)
        self.out = (0.1 * rng.standard_normal((2 * hidden, len(languages)))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [getattr(d, k) for d in (self.forward, self.backward) for k in Direction.names] + [self.out, self.bias]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of the languages at each position: (steps, lanes, languages)."""
        s = self.forward.run(x) @ self.out[: len(self.out) // 2]
        s += self.backward.run(x[::-1])[::-1] @ self.out[len(self.out) // 2 :]
        s += self.bias
        s -= s.max(axis=-1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=-1, keepdims=True))

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the positions that hold a byte, each labelled with its window's language."""
        H = len(self.out) // 2
        f, fk = self.forward.run(x, True)
        b, bk = self.backward.run(x[::-1], True)
        states = np.concatenate([f, b[::-1]], axis=2)
        s = states @ self.out + self.bias
        s -= s.max(axis=-1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=-1, keepdims=True)
        real = (x < 256).astype(np.float32)
        n = max(real.sum(), 1)
        picked = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[..., 0]
        loss = float(-(np.log(np.maximum(picked, 1e-12)) * real).sum() / n)
        d = p.copy()
        d[:, np.arange(len(y)), y] -= 1
        d *= (real / n)[..., None]
        d_states = d @ self.out.T
        gf = self.forward.back(x, fk, d_states[..., :H])
        gb = self.backward.back(x[::-1], bk, d_states[::-1, :, H:])
        flat = states.reshape(-1, 2 * H)
        return loss, [gf[k] for k in Direction.names] + [gb[k] for k in Direction.names] + [flat.T @ d.reshape(len(flat), -1), d.sum(axis=(0, 1))]

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = 240, batch: int = 96, rate: float = 0.02, seed: int = 1) -> float:
        """Adam over random windows; returns the last loss."""
        rng = np.random.default_rng(seed)
        params = self.parameters()
        m, v, loss = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0.0
        for k in range(1, rounds + 1):
            some = rng.integers(0, x.shape[1], batch)
            loss, grads = self.loss_and_gradients(x[:, some], y[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            lr = rate * min(1, 4 * (1 - k / (rounds + 1)))
            for p, g, a, b in zip(params, grads, m, v):
                g = g / max(norm, 1)
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= lr * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-8)
        return loss

    def document_scores(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-probabilities over all positions of each text: (texts, languages)."""
        total = np.zeros((len(texts), len(self.languages)))
        x, owner, _ = windows(texts)
        for a in range(0, x.shape[1], _LANES):
            part = x[:, a : a + _LANES]
            s = (self.positions(part) * (part < 256)[..., None]).sum(axis=0)
            np.add.at(total, owner[a : a + _LANES], s)
        return total / np.maximum([len(t) for t in texts], 1)[:, None]


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into windows: (bytes (WINDOW, windows) with 256 past an end, text of each window, lengths)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = -(-sizes // WINDOW)
    padded = np.full(int(count.sum()) * WINDOW, 256, np.int16)
    first = np.cumsum(count) - count
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.arange(len(raw)) + np.repeat(first * WINDOW - (np.cumsum(sizes) - sizes), sizes)
    padded[at] = raw
    return np.ascontiguousarray(padded.reshape(-1, WINDOW).T), np.repeat(np.arange(len(texts)), count), sizes


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> ByteTagger | None:
    """Learn from the whole texts of rows with a language: of each language, the rows of least id hash. Batches are drawn
    from all their windows."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    total = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(total)
    if not languages:
        return None
    chance = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, 2.0 * fit_rows / total[name]))) for name in languages])
    some = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < chance * (1 << 20))
    cut = some.select("lang", "text", F.xxhash64("id").alias("h")).orderBy("h").limit(2 * fit_rows * len(languages) + 1000).toPandas()
    texts, y = [], []
    for k, name in enumerate(languages):
        some = [t.encode("utf-8", "replace") for t in cut.loc[cut["lang"] == name, "text"][:fit_rows] if t]
        texts += some
        y += [k] * len(some)
    if not texts:
        return None
    x, owner, _ = windows(texts)
    model = ByteTagger(languages)
    if len(languages) > 1:
        model.train(x, np.array(y)[owner])
    return model


def predict(docs: DataFrame, model: ByteTagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; score is the pooled probability of the predicted language."""
    # A few thousand numbers, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in _portions(batch):
                texts = [t.as_py() for t in part.column(1)]
                some = [i for i, t in enumerate(texts) if m is not None and t and _LETTER.search(t)]
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                if some:
                    pooled = m.document_scores([texts[i].encode("utf-8", "replace") for i in some])
                    p = np.exp(pooled - pooled.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    for i, row in zip(some, p):
                        lang[i], score[i] = m.languages[int(row.argmax())], float(row.max())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score)], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, lang_pred string, score double")


def _portions(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    from .common import byte_slices

    yield from byte_slices([batch], "text", limit)


def op8_language_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from those whose crc32 remainder by 4 is not 2."""
    docs = documents(spark, sf_dir)
    found = predict(docs, train(docs.where(crc_bucket("doc_id", 4) != 2))).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
