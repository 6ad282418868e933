"""SimHash near-duplicates found with BK-trees.

Fingerprints are computed in Arrow batches and collapsed to distinct values before anything is compared.
Candidate shards are keyed by blocks of fingerprint bits, so that a query reaches every shard that can hold
a neighbour; inside a shard a BK-tree (children keyed by their integer Hamming distance to the parent)
answers the radius search, following only edges within the radius. A shard sends out a spanning forest of
the links it found, never all pairs, and the components are joined up by distributed star rounds.

Defined results: null text counts as no words, no words give fingerprint zero, which is linked like any
other; repeated rows share a fingerprint; an empty table gives an empty result; a null id never becomes a
component id unless all ids of its group are null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, join_hot, materialize, with_release
from .components import connected_components

SEED = 42
_LOW = np.uint64(0x0101010101010101)
_GOLDEN = 0x9E3779B97F4A7C15
_FLUSH = 400_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, repeats included; fewer words: one hash of all of them."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*(w[k:] for k in range(words))))), np.uint64, len(w) - words + 1)


def _stream(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit hash of each shingle; the first is XXH64 itself, others are mixed from it."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(_GOLDEN * k & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def majority_bits(h: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """(documents, 8*width) bytes, most significant bit first: a bit is 1 if over half of a document's
    hashes have it. Bits are summed as byte lanes of 64-bit words, at most 255 rows at a time."""
    out = np.zeros((len(counts), 8 * width), np.uint8)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
    runs = -(-counts[full] // 255)
    first = np.concatenate(([0], np.cumsum(runs)[:-1]))
    cuts = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    for k in range(width):
        x = _stream(h, k)
        total = np.empty((len(full), 64), np.int64)
        for j in range(8):
            lanes = np.add.reduceat((x >> np.uint64(j)) & _LOW, cuts)
            byte = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)  # little-endian: lane b holds bit 8*b+j
            total[:, j::8] = np.add.reduceat(byte, first, axis=0)
        ones = (2 * total > counts[full][:, None]).astype(np.uint8)
        out[full, 8 * k : 8 * k + 8] = np.packbits(ones[:, ::-1], axis=1)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, width: int = 1) -> DataFrame:
    """(id long, fp binary of 8*width bytes) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
            bits = majority_bits(h, np.array(counts, np.int64), width)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([b.tobytes() for b in bits], pa.binary())], ["id", "fp"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = shingle_hashes(text.as_py(), words)
                ids.append(i)
                hashes.append(h)
                counts.append(len(h))
                held += len(h)
                if held >= _FLUSH or len(ids) >= 20_000:
                    yield flush()
                    ids, hashes, counts, held = [], [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp binary")


class BKForest:
    """BK-trees of many groups at once, as flat arrays. An item's children are keyed by their integer
    Hamming distance to it; a group's first item is its root. Building and searching advance all items
    by one level a step."""

    def __init__(self, words: np.ndarray, roots: np.ndarray):
        """words: (items, width) uint64; roots: for each item, the index of its group's first item."""
        self.words, self.roots = words, roots
        n = len(words)
        self.span = 64 * words.shape[1] + 1
        self.parent = np.full(n, -1, np.int64)
        self.edge = np.zeros(n, np.int64)
        self.met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pending = np.flatnonzero(roots != np.arange(n))
        at = roots[pending]
        while len(pending):
            d = self.distance(pending, at)
            self.met.append((pending, at, d))
            key = at * self.span + d
            order = np.argsort(key, kind="stable")
            lead = np.ones(len(order), bool)
            lead[1:] = key[order[1:]] != key[order[:-1]]
            child = np.empty(len(order), np.int64)
            child[order] = pending[order][np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
            new = child == pending
            self.parent[pending[new]] = at[new]
            self.edge[pending[new]] = d[new]
            pending, at = pending[~new], child[~new]
        self.child = np.lexsort((self.edge, self.parent))
        self.child = self.child[self.parent[self.child] >= 0]
        self.key = self.parent[self.child] * self.span + self.edge[self.child]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.words[a] ^ self.words[b]).sum(axis=1, dtype=np.int64)

    def within(self, queries: np.ndarray, radius: int, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, other) at most `radius` apart, in pieces; every pair is met from both ends."""
        stack = [(queries[i : i + 8192], self.roots[queries[i : i + 8192]]) for i in range(0, len(queries), 8192)]
        while stack:
            q, node = stack.pop()
            if len(q) > limit:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = self.distance(q, node)
            hit = (d <= radius) & (q != node)
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.key, node * self.span + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.key, node * self.span + np.minimum(d + radius, self.span - 1), "right")
            n = hi - lo
            if n.sum():
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                stack.append((np.repeat(q, n), self.child[np.repeat(lo, n) + offset]))


class Union:
    """Vectorised disjoint sets whose representative is the least index."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def settle(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if len(a):
                np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
                self.settle()


def link_groups(words: np.ndarray, roots: np.ndarray, radius: int) -> np.ndarray:
    """For each item, the least item of its group reachable over links of at most `radius` bits.

    Distances met while the trees are built already unite most of a tight group; only groups that are
    still in several parts are searched."""
    forest, sets = BKForest(words, roots), Union(len(words))
    for a, b, d in forest.met:
        near = d <= radius
        sets.join(a[near], b[near])
    forest.met = []
    apart = np.unique(roots[sets.root != roots])
    queries = np.flatnonzero(np.isin(roots, apart))
    for a, b in forest.within(queries, radius):
        sets.join(a, b)
    return sets.root


def _linker(radius: int, width: int, flush: int = 200_000):
    """mapInArrow body over rows (key, rep, fp) sorted by key: a spanning forest (u, v) of each key's links."""

    def solve(keys: list, reps: list, fps: list) -> pa.RecordBatch:
        k = np.concatenate(keys)
        rep = np.concatenate(reps)
        words = np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(-1, width)
        lead = np.ones(len(k), bool)
        lead[1:] = k[1:] != k[:-1]
        roots = np.maximum.accumulate(np.where(lead, np.arange(len(k)), 0))
        size = np.bincount(roots, minlength=len(k))[roots]
        some = np.flatnonzero(size > 1)
        back = np.full(len(k), -1)
        back[some] = np.arange(len(some))
        found = link_groups(words[some], back[roots[some]], radius)
        moved = np.flatnonzero(found != np.arange(len(some)))
        return pa.RecordBatch.from_arrays([pa.array(rep[some][moved]), pa.array(rep[some][found[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, reps, fps, held = [], [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k, r, f = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            if held >= flush:  # cut where the key changes, so that a group stays whole
                cut = int(np.argmax(k != keys[-1][-1])) if (k != keys[-1][-1]).any() else len(k)
                keys.append(k[:cut])
                reps.append(r[:cut])
                fps += f[:cut]
                k, r, f = k[cut:], r[cut:], f[cut:]
                if not len(k):
                    continue
                yield solve(keys, reps, fps)
                keys, reps, fps, held = [], [], [], 0
            keys.append(k)
            reps.append(r)
            fps += f
            held += len(k)
        if keys:
            yield solve(keys, reps, fps)

    return run


def pigeonhole_keys(fp: F.Column, radius: int) -> F.Column:
    """Keys of a 64-bit fingerprint, split into radius+1 blocks: two values that differ in at most `radius`
    bits are equal in at least one block, so no link is lost."""
    value = F.conv(F.hex(fp), 16, -10).cast("long")
    blocks = radius + 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return F.array(*[
        F.xxhash64(F.lit(i), F.shiftrightunsigned(F.shiftleft(value, lo), 64 - (hi - lo))) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ])


def refined_keys(fp: F.Column, radius: int) -> F.Column:
    """Keys for shards that are too large: equal in one block, and, by the same argument over the remaining
    bits, equal in one of radius+1 parts of those."""
    value = F.conv(F.hex(fp), 16, -10).cast("long")
    blocks = radius + 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        outer = F.shiftrightunsigned(F.shiftleft(value, lo), 64 - (hi - lo))
        rest = [b for b in range(64) if not lo <= b < hi]
        parts = [rest[round(len(rest) * j / blocks) : round(len(rest) * (j + 1) / blocks)] for j in range(blocks)]
        subs = []
        for j, bits in enumerate(parts):
            mask = sum(1 << (63 - b) for b in bits)
            mask -= (mask >> 63) << 64
            subs.append(F.xxhash64(F.lit(i), F.lit(j), outer, value.bitwiseAND(F.lit(mask))))
        keys.append(F.array(*subs))
    return F.array(*keys)


def near_duplicates(fps: DataFrame, radius: int = 3, large: int = 4096) -> DataFrame:
    """fps (id, fp of 64 bits) -> (id, fp, component): groups linked by fingerprints at most `radius` bits apart.

    Shards of over `large` distinct fingerprints are dealt out by finer exact keys."""
    fps = materialize(fps, "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("times"))
    shards = reps.where("rep is not null").select("rep", "fp", F.posexplode(pigeonhole_keys(F.col("fp"), radius)).alias("block", "key"))
    # Shards that one task should not hold whole are dealt again by finer keys; their list is short.
    big = shards.groupBy("key").count().where(F.col("count") > large).select("key", F.lit(True).alias("hot"))
    finer = refined_keys(F.col("fp"), radius)
    shards = shards.join(big, "key", "left").select("rep", "fp", F.explode(F.when(F.col("hot"), finer[F.col("block")]).otherwise(F.array("key"))).alias("key"))
    links = shards.select("key", "rep", "fp").repartition(F.col("key")).sortWithinPartitions("key", "rep").mapInArrow(_linker(radius, 1), "u long, v long")
    labels = connected_components(links)
    named = reps.join(labels, reps.rep == labels.node, "left").select("fp", F.coalesce("component", "rep").alias("component"), "times")
    # A fingerprint of very many rows, such as that of texts without words, is dealt to several tasks.
    return join_hot(fps, named, "fp", "times").select("id", "fp", "component")


#: Keys are made of 5 minima each. Two texts share a minimum with a chance equal to their similarity, so at 0.8
#: they miss all 24 keys with chance (1 - 0.8**5)**24 = 7e-5, at 0.85 with 2e-6, whatever the number of rows.
KEY_MINIMA, KEYS = 5, 24
#: Candidate groups of more texts than this are dealt out by key instead of whole.
LARGE_GROUP = 256
#: Texts that meet in one cell, about; two such lots where a group is cut.
CELL = 1024
#: Cells are searched by fingerprints of 64 * WIDE bits, WIDE_RADIUS of which may differ. Sets of similarity 0.8 differ in
#: some 39 of 256 bits, by a standard deviation of 6, and in 48 bits where they have 4 and 5 shingles; unrelated ones in 128.
WIDE, WIDE_RADIUS = 4, 96
_MASKS, _ODD = np.random.default_rng(11).integers(0, 2**64, (2, KEYS * KEY_MINIMA), dtype=np.uint64) | np.array([[0], [1]], np.uint64)


def shared_minima(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(documents, KEYS) keys of the non-empty hash sets that begin at `starts`."""
    out = np.empty((len(starts), KEYS), np.int64)
    with np.errstate(over="ignore"):
        for t in range(KEYS):
            key = np.full(len(starts), t, np.uint64)
            for k in range(t * KEY_MINIMA, (t + 1) * KEY_MINIMA):
                key = key * np.uint64(_GOLDEN) + np.minimum.reduceat((h ^ _MASKS[k]) * _ODD[k], starts)
            out[:, t] = _stream(key, t + 1).view(np.int64)
    return out


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def set_digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, flush: int = 100_000) -> DataFrame:
    """(id, same, keys) for every row: the digest of its shingle set, and the keys it is looked up by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held = [], [], 0

        def send() -> pa.RecordBatch:
            size = np.array([len(x) for x in sets], np.int64)
            full = size > 0
            keys = np.empty((0, KEYS), np.int64)
            if full.any():
                keys = shared_minima(np.concatenate(sets), (np.cumsum(size) - size)[full])
            offsets = np.concatenate(([0], np.cumsum(full * KEYS))).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([set_digest(x) for x in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], ["id", "same", "keys"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                sets.append(shingle_set(text.as_py(), words))
                held += len(sets[-1])
                if held >= flush or len(ids) >= 20_000:
                    yield send()
                    ids, sets, held = [], [], 0
        if ids:
            yield send()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(with_release(run), "id long, same binary, keys array<long>")


def confirmed(sets: list[np.ndarray], roots: np.ndarray, known: np.ndarray | None = None, chunk: int = 512) -> np.ndarray:
    """For each set, the least index of its cell reachable over links of Jaccard similarity 0.8 or more, and over equal
    numbers in `known`. roots: the index of the first set of each one's cell. Pairs are those that BK-trees over the
    sets' fingerprints find within WIDE_RADIUS bits, each checked by the sets themselves. Pairs that are already
    connected are not compared."""
    groups = Union(len(sets))
    if known is not None:
        order = np.lexsort((known, roots))
        lead = np.ones(len(order), bool)
        lead[1:] = (known[order[1:]] != known[order[:-1]]) | (roots[order[1:]] != roots[order[:-1]])
        groups.join(order, order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))])
    size = np.array([len(x) for x in sets], np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), bool)
    bits = majority_bits(np.concatenate(sets), size, WIDE)
    codes = np.split(codes, np.cumsum(size)[:-1])
    forest = BKForest(bits.view(">u8").astype(np.uint64), roots)

    def check(a: np.ndarray, b: np.ndarray) -> None:
        fits = (5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b])) & (size[a] > 0) & (groups.root[a] != groups.root[b])
        order = np.argsort(a[fits], kind="stable")
        a, b = a[fits][order], b[fits][order]
        for i, others in zip(*_runs(a, b)):
            mark[codes[i]] = True
            for at in range(0, len(others), chunk):
                js = others[at : at + chunk]
                js = js[groups.root[js] != groups.root[i]]
                if len(js):
                    both = np.add.reduceat(mark[np.concatenate([codes[j] for j in js])], np.cumsum(size[js]) - size[js], dtype=np.int64)
                    hit = js[9 * both >= 4 * (size[js] + size[i])]  # both / (a + b - both) >= 4 / 5, in integers
                    groups.join(np.full(len(hit), i), hit)
            mark[codes[i]] = False

    # Distances met while the trees are built already connect most of a tight cell.
    for a, b, d in forest.met:
        near = d <= WIDE_RADIUS
        check(b[near], a[near])
    forest.met = []
    # A pair that is not connected has an end outside the largest part of its cell.
    part, first, count = np.unique(groups.root, return_index=True, return_counts=True)
    order = np.lexsort((count, roots[first]))
    last = np.ones(len(order), bool)
    last[:-1] = roots[first][order[1:]] != roots[first][order[:-1]]
    asked = ~np.isin(groups.root, part[order[last]])
    for a, b in forest.within(np.flatnonzero(asked), WIDE_RADIUS, 1 << 17):
        once = (a < b) | ~asked[b]
        check(a[once], b[once])
    return groups.root


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct values of a, which is sorted, and the values of b beside each."""
    lead = np.flatnonzero(np.concatenate((np.ones(min(len(a), 1), bool), a[1:] != a[:-1])))
    return a[lead].tolist(), np.split(b, lead[1:]) if len(lead) else []


def _confirmer(words: int, flush: int = CELL):
    """mapInArrow body over rows (cell, id, same, known, text) sorted by cell: a spanning forest (u, v) of the links
    of each cell. A row whose text is another one of the same id is passed over. Small cells are solved together."""

    def solve(cells: list[dict]) -> pa.RecordBatch:
        ids = np.array([i for c in cells for i, _ in c], np.int64)
        size = np.array([len(c) for c in cells], np.int64)
        roots = np.repeat(np.cumsum(size) - size, size)
        found = confirmed([h for c in cells for h, _ in c.values()], roots, np.array([k for c in cells for _, k in c.values()], np.int64))
        moved = np.flatnonzero(found != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[found[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, cells, held = None, {}, [], 0
        for batch in batches:
            for cell, i, same, known, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                if cell != now:
                    if len(members) > 1:
                        cells.append(members)
                        held += len(members)
                    if held >= flush:
                        yield solve(cells)
                        cells, held = [], 0
                    now, members = cell, {}
                if (i, same) not in members:
                    h = shingle_set(text.as_py(), words)
                    if set_digest(h) == same:
                        members[i, same] = h, known
        if len(members) > 1:
            cells.append(members)
        if cells:
            yield solve(cells)

    return with_release(run)


def similar_groups(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, component) for every row: groups linked by a Jaccard similarity of 0.8 or more of their shingle sets.

    Texts with equal sets are one. Others are candidates if they share a key; the texts of a group of candidates
    meet in cells of a bounded number, each a BK-tree of fingerprints, whose finds are decided by the sets themselves. Members of a large group meet
    by key. A group of more than CELL texts is cut into cells that share its first text; then only texts which that
    did not connect to the first meet all others, cell by cell, and no pair that is connected is compared again."""
    rows = materialize(sketches(docs, id_col, text_col, words), "sketches")
    reps = rows.groupBy("same").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"), F.count("*").alias("times"))
    keyed = reps.where("rep is not null").select("rep", "same", F.explode("keys").alias("key"))
    low = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(join_hot(keyed, low, "key", "n").drop("n"), "shared")
    near = connected_components(shared.select(F.col("rep").alias("u"), F.col("low").alias("v")))
    placed = join_hot(near, near.groupBy("component").count(), "component", "count")
    group = F.when(F.col("count") > LARGE_GROUP, F.col("key")).otherwise(F.col("component")).alias("group")
    deal_table = materialize(shared.join(placed, shared.rep == placed.node).select(group, "rep", "same").distinct(), "deal")
    made: list[DataFrame] = []
    deal, sizes = deal_table, deal_table.groupBy("group").agg(F.count("*").alias("n"), F.min("rep").alias("hub"))
    deal = join_hot(deal, sizes, "group", "n").withColumn("parts", F.ceil(F.col("n") / CELL).cast("int"))
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))

    def links_in(cells: DataFrame, *cell: str) -> DataFrame:
        # The list of candidates grows with the input, so it is never broadcast.
        met = texts.join(cells.select(F.xxhash64("group", *cell).alias("cell"), "rep", "same", "known").hint("merge"), "rep")
        met = met.select("cell", "rep", "same", "known", "text").repartition(F.col("cell")).sortWithinPartitions("cell", "rep")
        made.append(materialize(met.mapInArrow(_confirmer(words), "u long, v long"), "links"))
        return made[-1]

    own = lambda parts: F.pmod(F.xxhash64("rep", "same"), parts).cast("int")
    every = lambda parts: F.sequence(F.lit(0), parts - 1)
    first = deal.withColumn("known", F.col("rep")).withColumn("part", F.explode(F.when((F.col("rep") == F.col("hub")) & (F.col("parts") > 1), every(F.col("parts"))).otherwise(F.array(own(F.col("parts"))))))
    links = links_in(first, "part")
    large = deal.where("parts > 1")
    if not sizes.where(F.col("n") > CELL).isEmpty():
        so_far = connected_components(links)
        known = large.join(so_far, large.rep == so_far.node, "left").withColumn("known", F.coalesce("component", "rep")).drop("node", "component")
        known = materialize(known, "known")
        made.append(known)
        main = known.where("rep = hub").groupBy("group").agg(F.min("known").alias("main"), F.max("n").alias("n"))
        apart = join_hot(known.drop("n"), main, "group", "n").where("known != main")
        counts = apart.groupBy("group").agg(F.count("*").alias("m"), F.max("n").alias("n")).withColumn("apart_parts", F.ceil(F.col("m") / CELL).cast("int")).drop("m")
        apart = join_hot(apart.drop("n", "main"), counts, "group", "n")
        others = join_hot(known.drop("n"), counts, "group", "n")
        pick = ["group", "rep", "same", "known", "part", "apart"]
        cells = apart.withColumn("apart", own(F.col("apart_parts"))).withColumn("part", F.explode(every(F.col("parts")))).select(pick)
        cells = cells.union(others.withColumn("part", own(F.col("parts"))).withColumn("apart", F.explode(every(F.col("apart_parts")))).select(pick))
        links = links.union(links_in(cells, "part", "apart"))
    labels = connected_components(links)
    named = reps.select("same", "rep", "times").join(labels, reps.rep == labels.node, "left").select("same", F.coalesce("component", "rep").alias("component"), "times")
    found = materialize(join_hot(rows.select("id", "same"), named, "same", "times").select("id", "component"), "groups")
    for done in (rows, shared, deal_table, *made):
        discard(done)
    return found


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows of docs that are the first, by id, of their group of near-duplicates; columns as they are.

    Rows that share an id are one document, and stay once for each text; rows without an id stay."""
    found = similar_groups(docs, id_col, text_col, words)
    first = found.groupBy("id").agg(F.max(F.col("id") == F.col("component")).alias("first"), F.count("*").alias("times"))
    # The list of ids grows with the input, so it is never broadcast.
    gone = first.where(~F.col("first")).select(F.col("id").alias("gone")).hint("merge")
    kept = docs.join(gone, docs[id_col].cast("long") == gone["gone"], "left_anti")
    if first.where("id is not null and times > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col, text_col])
    return kept


def op7_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 64-bit fingerprint of 3-word shingles and the least doc_id reachable over links of
    at most 3 differing bits."""
    found = near_duplicates(fingerprints(documents(spark, sf_dir), words=3), radius=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
