"""Embedding near-duplicates by product quantisation.

Vectors are scaled to length 1 and assigned to coarse inverted lists; the rest of each vector is coded by one
centroid a subspace. A query probes its own list and those whose border is near: a list is passed over if the
query is further than a margin from the half-space nearer to that list's centroid than to the query's own, or
further than the search distance from the ball of the list's radius. The margin is a share of the search distance,
measured on the fit sample: the least at which neighbours at just the threshold, in random directions, are probed
with the wanted recall, by default 0.97; those nearer than the threshold are found more often still. With
recall=1.0 the margin is the whole search distance, and nothing can be missed. In a list, asymmetric table-lookup
distances from the query to the codes, lowered by each code's own known error, drop only vectors that cannot be
neighbours; the others are compared exactly, in double precision.

Coarse centroids and codebooks are fitted to a bounded sample (FIT_ROWS, in hash order) for each length of vectors
in it; every row is indexed. Vectors of a length that the sample does not hold are one list and compared exactly.
Equal vectors are one class with a count, so copies are never expanded. A probe task holds a block of queries
against a block of a list; it sends counts and a spanning forest, never all pairs.

Defined results: a null label, or a vector that is null, empty, zero or has null or non-finite components, links
with nothing; vectors of different lengths do not link; empty tables give empty results; repeated rows are linked
to each other like any others; extra columns are ignored. A repeated vec_id with different vectors counts as
different vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize
from .components import connected_components
from .simhash import Union

#: Documented bounds of what is fitted and broadcast.
FIT_ROWS = 12_000
MAX_LISTS = 2048
SUBSPACES = 8
CENTROIDS = 64
BLOCK = 4096


def lloyd(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k-means centroids of the rows of x, from distinct rows; fewer rows give fewer centroids."""
    rows = np.unique(x, axis=0)
    if len(rows) <= k:
        return rows
    c = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.bincount(near, minlength=len(c))
        c[size > 0] = total[size > 0] / size[size > 0][:, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances between rows."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + BLOCK], c).argmin(1) for i in range(0, len(x), BLOCK)]) if len(x) else np.empty(0, np.int64)


class Quantiser:
    """Coarse centroids and one codebook for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, centroids: int = CENTROIDS):
        self.coarse = lloyd(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).round().astype(int)
        self.gaps = np.sqrt(distances(self.coarse, self.coarse))
        self.books = [lloyd(rest[:, a:b], centroids) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error of the coded vector, distance to the list's centroid)."""
        cell = nearest(x, self.coarse)
        rest = x - self.coarse[cell]
        codes = np.column_stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]).astype(np.uint8)
        error = np.sqrt(((rest - self.decode(codes)) ** 2).sum(1))
        return cell, codes, error, np.sqrt((rest**2).sum(1))

    def margin(self, sample: np.ndarray, threshold: float, recall: float) -> float:
        """The share of the search distance that borders are looked across to have a recall of planted neighbours."""
        if recall >= 1:
            return 1.0
        rng = np.random.default_rng(1)
        x = sample[rng.permutation(len(sample))[:2000]]
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(1)[:, None] * x
        size = np.sqrt((side**2).sum(1))
        x, side = x[size > 1e-9], side[size > 1e-9] / size[size > 1e-9][:, None]
        if not len(x):
            return 1.0
        there = nearest(threshold * x + math.sqrt(1 - threshold**2) * side, self.coarse)
        for share in np.arange(0.05, 1.0, 0.05):
            own, asked = self.near_lists(x, share * math.sqrt(2 - 2 * threshold))
            if asked[np.arange(len(x)), there].mean() >= recall:
                return float(share)
        return 1.0

    def near_lists(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances to all centroids, which lists have a border within the margin)."""
        squared = distances(x, self.coarse)
        own = squared.argmin(1)
        return squared, squared - squared[np.arange(len(own)), own][:, None] <= 2 * margin * self.gaps[own] + 1e-7

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)

    def tables(self, rest: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each query residual to each centroid of each subspace."""
        return [distances(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]


def _unit(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 1))


class _OneList(Quantiser):
    """Vectors of a length without a sample: one list, and codes that rule nothing out."""

    def __init__(self, size: int):
        self.coarse, self.gaps, self.cuts, self.books = np.zeros((1, size)), np.zeros((1, 1)), np.array([0, size]), [np.zeros((1, size))]


def near_duplicates(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", recall: float = 0.97) -> DataFrame:
    """(id, n_links, component, kept) for every row; links join rows of equal labels with cosine >= threshold."""
    spark = rows.sparkSession
    vec = F.col("vec")
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf)))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vec") > 0) & finite & F.exists(vec, lambda v: v != 0), F.lit(False))
    # Vectors only meet those of their own label and length; a digest stands for a vector from here on.
    base = base.withColumn("label", F.when(usable, F.concat_ws(":", F.size("vec"), "label")))
    base = base.withColumn("digest", F.when(usable, F.sha2(F.concat_ws(",", "label", vec.cast("array<string>")), 256)))
    base = materialize(base, "vectors")
    scale = F.array_max(F.transform(vec, F.abs))
    unit_norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, v: s + v * v))
    classes = base.where("digest is not null").groupBy("digest").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = classes.withColumn("scaled", F.transform(vec, lambda v: v / scale)).withColumn("n", unit_norm)
    classes = classes.select("digest", "label", "least", "copies", F.transform("scaled", lambda v: v / F.col("n")).alias("unit"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    sample = classes.select("unit", "digest").orderBy("digest").limit(FIT_ROWS).toPandas()
    if not len(sample):
        return base.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept"))
    in_label = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    lists_wanted = int(min(MAX_LISTS, max(1, round(2 * math.sqrt(in_label)))))
    # Bounded by FIT_ROWS, MAX_LISTS and CENTROIDS, whatever the input: one quantiser and margin for each length.
    fitted = {}
    for size, part in sample.groupby(sample["unit"].map(len)):
        x = np.stack(part["unit"].to_numpy()).astype(np.float64)
        quantiser = Quantiser(x, lists_wanted)
        fitted[int(size)] = quantiser, quantiser.margin(x, threshold, recall)
    shared = spark.sparkContext.broadcast(fitted)
    reach = math.sqrt(2 - 2 * threshold) + 1e-9

    def of_size(size: int) -> tuple[Quantiser, float]:
        return shared.value.get(size) or (_OneList(size), 1.0)

    def by_size(frame: pd.DataFrame):
        return frame.groupby(frame["unit"].map(len)) if len(frame) else ()

    fields = "cls long, label string, copies long, unit array<double>, cell int, codes binary, error double, away double"

    def index(frames):
        for frame in frames:
            for size, part in by_size(frame):
                cell, codes, error, away = of_size(size)[0].encode(_unit(part["unit"]))
                yield part[["cls", "label", "copies", "unit"]].assign(cell=cell.astype(np.int32), codes=[c.tobytes() for c in codes], error=error, away=away)

    coded = materialize(classes.select("cls", "label", "copies", "unit").mapInPandas(index, fields), "codes")
    # Radius and size of each (label, list): one row each, at most labels x MAX_LISTS.
    lists = coded.groupBy("label", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("members"))
    # Large lists are cut into blocks; a query goes to every block of each list it probes.
    lists = lists.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))

    def probes(frames):
        for frame in frames:
            for size, part in by_size(frame):
                q, margin = of_size(size)
                squared, border = q.near_lists(_unit(part["unit"]), margin * reach)
                radius = np.stack(part["radii"].to_numpy()).astype(np.float64)[:, : len(q.coarse)]
                qi, ci = np.nonzero(border & (np.sqrt(squared) <= radius + reach + 1e-7))
                yield part[["cls", "label", "copies", "unit"]].iloc[qi].assign(cell=ci.astype(np.int32))

    widest = max(len(q.coarse) for q, _ in fitted.values())
    radii = lists.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("cell", "radius"))).alias("by_cell"))
    radii = radii.select("label", F.transform(F.sequence(F.lit(0), F.lit(widest - 1)), lambda c: F.coalesce(F.try_element_at("by_cell", c), F.lit(-10.0))).alias("radii"))
    asked = coded.select("cls", "label", "copies", "unit").join(radii, "label").mapInPandas(probes, "cls long, label string, copies long, unit array<double>, cell int")
    member = coded.join(lists.select("label", "cell", "blocks"), ["label", "cell"])
    member = member.select("label", "cell", F.pmod(F.hash("cls"), F.col("blocks")).alias("block"), F.lit(0).alias("side"), "cls", "copies", "unit", "codes", "error")
    asked = asked.join(lists.select("label", "cell", "blocks"), ["label", "cell"])
    asked = asked.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "cls", "copies", "unit", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"))
    asked = materialize(asked, "probes")
    key = ["label", "cell", "block"]

    def search(keys, frame):
        """Queries of one block against the coded members of one block of a list."""
        asking = frame["side"] == 1
        return _search(of_size(len(frame["unit"].iloc[0]))[0], int(keys[1]), frame[~asking], frame[asking], threshold, reach)

    # Queries are cut into blocks as well, so a hot list is many tasks; its members are repeated for each.
    counts = asked.groupBy(*key).count().select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    cut = asked.join(counts, key).withColumn("part", F.pmod(F.hash("cls", F.lit(7)), F.col("parts"))).drop("parts")
    member = member.join(counts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = member.unionByName(cut).groupBy(*key, "part").applyInPandas(search, "u long, v long, links long")
    found = materialize(found, "found")
    for done in (asked, coded):
        discard(done)
    components = connected_components(found.where("v is not null").select("u", "v"))
    links = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    named = classes.select("digest", "cls", "least", "copies").join(components, classes.cls == components.node, "left").drop("node")
    named = materialize(named.withColumn("root", F.coalesce("component", "cls")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    named = join_hot(named, least, "root", "n").drop("n").join(links, F.col("cls") == F.col("u"), "left")
    named = named.select("digest", F.coalesce("links", F.lit(0)).alias("others"), "copies", "first")
    # Rows without a class stay as they are; a class of very many copies is dealt to several tasks.
    single = base.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    linked = join_hot(base.where("digest is not null").select("id", "digest"), named, "digest", "copies")
    linked = linked.select("id", (F.col("others") + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("first", "id").alias("component"))
    return single.union(linked).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def _search(q: Quantiser, cell: int, member: pd.DataFrame, asked: pd.DataFrame, threshold: float, reach: float) -> pd.DataFrame:
    """Rows (u, null, links): links of query class u found here, copies counted; rows (u, v): a spanning forest."""
    empty = pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="Int64"), "links": pd.Series(dtype="int64")})
    if not len(member) or not len(asked):
        return empty
    codes = np.frombuffer(b"".join(member["codes"]), np.uint8).reshape(len(member), -1)
    x, y = _unit(member["unit"]), _unit(asked["unit"])
    xs, ys = member["cls"].to_numpy(), asked["cls"].to_numpy()
    copies, error = member["copies"].to_numpy(), member["error"].to_numpy()
    every = np.unique(np.concatenate([xs, ys]))
    xi, yi = np.searchsorted(every, xs), np.searchsorted(every, ys)
    sets, links = Union(len(every)), np.zeros(len(ys), np.int64)
    for a in range(0, len(y), 256):
        part = y[a : a + 256]
        tables = q.tables(part - q.coarse[cell])
        squared = sum(t[:, codes[:, k]] for k, t in enumerate(tables))
        qi, mi = np.nonzero(np.sqrt(squared) <= reach + error + 1e-7)
        for b in range(0, len(qi), 1 << 18):
            qs, ms = qi[b : b + (1 << 18)], mi[b : b + (1 << 18)]
            near = (np.einsum("ij,ij->i", part[qs], x[ms]) >= threshold) & (ys[a + qs] != xs[ms])
            qs, ms = qs[near], ms[near]
            links[a : a + len(part)] += np.bincount(qs, copies[ms], len(part)).astype(np.int64)
            sets.join(yi[a + qs], xi[ms])
    moved = np.flatnonzero(sets.root != np.arange(len(every)))
    some = np.flatnonzero(links)
    if not len(moved) and not len(some):
        return empty
    return pd.DataFrame({
        "u": np.concatenate([every[moved], ys[some]]),
        "v": pd.array([*every[sets.root[moved]].tolist(), *[None] * len(some)], dtype="Int64"),
        "links": np.concatenate([np.zeros(len(moved), np.int64), links[some]]),
    })


def op4_embeddings_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and representatives of all embeddings."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
