"""Language-model scores from an Elias-Fano n-gram trie.

Counting is distributed: map tasks send each shard one compressed block of sorted distinct keys and counts
a flush, and the task of a shard merges them and writes one memory-mapped level file into the shared folder.
  level 1  words, as 64-bit hashes in an Elias-Fano sequence, with exact counts; the index is the word's id
  level 2  word pairs: first words, monotone pointers, successor ids, discounted
           probabilities quantised to 16 bits
  level 3  word triples: the third word is kept as its rank among the successors of the
           second, so that searches are relative to that context
Shards are ranges of ids cut at equal shares of the tokens; very frequent first words are cut again by their
second word, so that no task gets a hot word whole. Workers map the files and never load the model; so they do
with the directory of the shards, of some 60 bytes for each 4 million tokens, which plans name by its path only.

Smoothing is interpolated absolute discounting over add-one word probabilities, with unknown words as one
more word. The query keeps all pairs and triples; min_count can prune rarer ones, whose mass then goes to the
shorter context. Base counts are exact and unpruned.

Word ids are 64-bit hashes: at 200 million distinct words the chance of any collision is about one in 1,000.

Defined results: null and empty texts are one end token; an empty table, or one without training rows,
scores by the uniform unknown word; repeated rows score alike; a null id is hashed as the empty text for the
split; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import drop_at_exit
from .common import byte_slices, bytes_of, crc_bucket, documents, scratch_path
from .eliasfano import EliasFano, SortedLists, filesystem, lists_build, map_arrays, write_arrays

END = xxhash.xxh64_intdigest(b"")
#: Bytes of text that a map task takes together before it sends blocks, some 1.4 million tokens.
FLUSH = 9_000_000
#: Tokens to a shard of the model.
SHARD_TOKENS = 4_000_000
#: Level files that a worker keeps mapped.
OPEN_FILES = 4096
_BLOCK = "shard long, block binary"
_DONE = "shard long, path string, n long, total long, edges binary"
_STEP = 12.0 / 65535


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct lower-cased words of some texts and of the end, which of them each token is, tokens of each
    text). A text's words are followed by the end. Words are cut and told apart in Arrow arrays, and hashed once each."""
    data, ends = bytes_of(texts)
    inner = ~_SPACE[data]
    begin = inner.copy()
    begin[1:] &= ~inner[:-1]
    head = ends[:-1][ends[:-1] < len(data)]
    begin[head] = inner[head]
    at = np.flatnonzero(begin)
    last = inner.copy()
    last[:-1] &= ~inner[1:] | begin[1:]
    # Words end to end, without what parts them.
    flat = _LOWER[data[inner]]
    bounds = np.concatenate(([0], np.cumsum(np.flatnonzero(last) + 1 - at)))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).dictionary_encode()
    found = len(coded.dictionary)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, found)
    counts = np.diff(np.concatenate(([0], np.searchsorted(at, ends)))) + 1
    which = np.full(len(at) + len(ends), found, np.int64)
    word = np.ones(len(which), bool)
    word[np.cumsum(counts) - 1] = False
    which[word] = coded.indices.to_numpy()
    return np.append(hashes, np.uint64(END)), which, counts


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, hashes of distinct tokens, which of them all tokens end to end are, tokens of each document), about FLUSH
    bytes of text at a time."""
    for part in byte_slices(batches, 1, FLUSH):
        yield part.column(0).to_pylist(), *tokens_of(part.column(1))


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as gaps, and counts, both by planes of bytes, most of which are zero."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for x in (np.diff(keys, prepend=np.uint64(0)), counts.astype("<u4"))]
    return zstandard.compress(b"".join(planes), 1)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(block), np.uint8)
    n = len(raw) // 12
    gaps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    counts = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint64), counts.astype(np.int64)


def _count(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    lead = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[lead], np.add.reduceat(counts, lead) if len(lead) else counts


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpack(x.as_py()) for x in table.column("block")]
    return _count(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _send(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """One block for each run of equal shards."""
    cut = np.append(np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))), len(shard)) if len(shard) else np.array([0])
    blocks = [_pack(keys[a:b], counts[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]], pa.int64()), pa.array(blocks, pa.binary())], ["shard", "block"])


def _done(shard: int, path: str, n: int, total: int, edges: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "path": [path], "n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64()), "edges": pa.array([edges.astype("<i8").tobytes()], pa.binary())})


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit steps of log10, down to 1e-12."""
    return np.round(-np.log10(np.maximum(p, 1e-12)) / _STEP).astype(np.uint16)


_RESTORE = 10.0 ** (-_STEP * np.arange(65536.0))


def restore(q: np.ndarray) -> np.ndarray:
    return _RESTORE[q]


def small_counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each; those of 255 and more beside them."""
    large = np.flatnonzero(counts >= 255)
    return {"count": np.minimum(counts, 255).astype(np.uint8), "large_at": large, "large": counts[large].astype(np.int64)}


def whole_counts(arrays: dict[str, np.ndarray], at: np.ndarray | None = None) -> np.ndarray:
    out = (arrays["count"] if at is None else arrays["count"][at]).astype(np.int64)
    some = np.flatnonzero(out == 255)
    out[some] = arrays["large"][np.searchsorted(arrays["large_at"], some if at is None else at[some])]
    return out


class Trie:
    """The mapped level files of one model, and their directory. `spec` has paths and a few numbers."""

    def __init__(self, spec: dict):
        self.spec, self.files = spec, {}
        listed = {level: map_arrays(spec["base"], spec[level])[0] if spec[level] else {} for level in ("words", "pairs", "triples")}
        self.names = {level: found.get("name", np.empty(0, "S1")) for level, found in listed.items()}
        none = np.empty(0, np.int64)
        self.word_shard, self.word_start = listed["words"].get("shard", none), np.append(listed["words"].get("first", none), spec["V"])
        self.pair_start = np.append(listed["pairs"].get("first", none), spec["n_pairs"])
        self.pair_from = listed["pairs"].get("from", np.empty(0, np.uint64))
        self.shared_id, self.shared_rest, self.shared_start = (listed["pairs"].get(k, none) for k in ("shared_id", "shared_rest", "shared_start"))

    def open(self, level: str, k: int) -> dict:
        key = (level, k)
        if key not in self.files:
            if len(self.files) >= OPEN_FILES:
                self.files.pop(next(iter(self.files)))
            arrays, _ = map_arrays(self.spec["base"], f"{filesystem(self.spec['base'])[1]}/{self.names[level][k].decode()}")
            found = {"arrays": arrays}
            if level == "words":
                found["ef"] = EliasFano(arrays, "word_")
            elif level == "pairs":
                found["ef"], found["lists"] = EliasFano(arrays, "ctx_"), SortedLists(arrays, "next_")
            else:
                found["lists"] = SortedLists(arrays, "next_")
            self.files[key] = found
        return self.files[key]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words; unknown ones are -1 and 0. Each distinct word is looked up once."""
        unique, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
        if len(self.word_shard):
            shard = word_shard(unique, self.spec["word_shards"])
            for number in np.unique(shard):
                k = int(np.searchsorted(self.word_shard, number))
                if k == len(self.word_shard) or self.word_shard[k] != number:
                    continue
                a, b = np.searchsorted(shard, [number, number + 1])
                f = self.open("words", k)
                at = f["ef"].find(unique[a:b])
                hit = at >= 0
                ids[a:b][hit] = at[hit] + self.word_start[k]
                counts[a:b][hit] = whole_counts(f["arrays"], at[hit])
        return ids[back], counts[back]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.word_start, ids, "right") - 1
        for k in np.unique(shard):
            some = np.flatnonzero(shard == k)
            out[some] = whole_counts(self.open("words", int(k))["arrays"], ids[some] - self.word_start[k])
        return out

    def pairs(self, keys: np.ndarray):
        """Sorted pair keys (first id << 32 | second id) -> position in level 2 or -1, rank among the first
        word's successors, discounted probability, and the rest mass left by the first word."""
        n = len(keys)
        at, rank, alpha, rest = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n), np.ones(n)
        shard = np.searchsorted(self.pair_from, keys, "right") - 1
        for k in np.unique(shard):
            if k < 0 or self.pair_start[k] == self.pair_start[k + 1]:
                continue
            a, b = np.searchsorted(shard, [k, k + 1])
            f = self.open("pairs", int(k))
            first, second = keys[a:b] >> np.uint64(32), keys[a:b] & np.uint64(0xFFFFFFFF)
            lead = np.concatenate(([True], first[1:] != first[:-1]))
            back = np.cumsum(lead) - 1
            slot = f["ef"].find(first[lead])
            known = slot >= 0
            if not known.any():
                continue
            left = np.ones(len(slot))
            left[known] = restore(f["arrays"]["rest"][slot[known]])
            rest[a:b] = left[back]
            some = np.flatnonzero(known[back])
            found, start = f["lists"].find(slot[known], second[some], (np.cumsum(known) - 1)[back[some]])
            hit = np.flatnonzero(found >= 0)
            there = a + some[hit]
            at[there] = found[hit] + self.pair_start[k]
            rank[there] = found[hit] - start[hit]
            alpha[there] = restore(f["arrays"]["alpha"][found[hit]])
        if len(self.shared_id) and n:
            # First words that lie in several shards: rest mass and first successor are known from all together.
            first = (keys >> np.uint64(32)).astype(np.int64)
            k = np.minimum(np.searchsorted(self.shared_id, first), len(self.shared_id) - 1)
            own = self.shared_id[k] == first
            rest[own] = self.shared_rest[k[own]]
            own &= at >= 0
            rank[own] = at[own] - self.shared_start[k[own]]
        return at, rank, alpha, rest

    def triples(self, pair: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(discounted probability, rest mass) of the rank-th successor in the context of a pair; both sorted by pair."""
        alpha, rest = np.zeros(len(pair)), np.ones(len(pair))
        shard = np.searchsorted(self.pair_start, pair, "right") - 1
        for t in np.unique(shard).tolist():
            if not self.names["triples"][t]:
                continue
            a, b = np.searchsorted(shard, [t, t + 1])
            f = self.open("triples", t)
            local = pair[a:b] - self.pair_start[t]
            lead = np.concatenate(([True], local[1:] != local[:-1]))
            back = np.cumsum(lead) - 1
            local = local[lead]
            rest[a:b] = restore(f["arrays"]["rest"][local])[back]
            some = np.flatnonzero(rank[a:b] >= 0)
            found, _ = f["lists"].find(local, rank[a:b][some].astype(np.uint64), back[some])
            hit = found >= 0
            alpha[a:b][some[hit]] = restore(f["arrays"]["alpha"][found[hit]])
        return alpha, rest

    def adjacent(self, ids: np.ndarray, counts: np.ndarray):
        """For each token but the first of a document: its pair's position, rank, probability and rest mass."""
        n = len(ids)
        at, rank, alpha, rest = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n), np.ones(n)
        inner = _inner(counts)
        where = np.flatnonzero(inner)
        where = where[ids[where - 1] >= 0]
        first, second = ids[where - 1], ids[where]
        # An unknown second word still needs the rest mass; no id reaches the largest number.
        key = (first.astype(np.uint64) << np.uint64(32)) | np.where(second >= 0, second, 0xFFFFFFFF).astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        lead = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
        back, where = np.cumsum(lead) - 1, where[order]
        a, r, p, m = self.pairs(key[lead])
        at[where], rank[where], alpha[where], rest[where] = a[back], r[back], p[back], m[back]
        return at, rank, alpha, rest, inner


def _inner(counts: np.ndarray) -> np.ndarray:
    """False at each document's first token."""
    out = np.ones(counts.sum(), bool)
    out[np.concatenate(([0], np.cumsum(counts)[:-1]))] = False
    return out


@lru_cache(maxsize=1)
def _opened(items: tuple) -> Trie:
    return Trie(dict(items))


def opened(spec: dict) -> Trie:
    return _opened(tuple(sorted(spec.items())))


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _reduce(blocks: DataFrame, build) -> dict[str, np.ndarray]:
    """Give each shard's blocks to one task; only a line for each shard, of some 4 million tokens, reaches the driver."""
    # Sorted here: a distributed sort would sample, and so build, every shard twice.
    done = blocks.groupBy("shard").applyInArrow(build, _DONE).toArrow().combine_chunks().sort_by("shard")
    found = {k: done.column(k).to_numpy() for k in ("shard", "n", "total")}
    edges = [np.frombuffer(x.as_py(), "<i8") for x in done.column("edges")]
    name = np.array([x.as_py().rsplit("/", 1)[-1].encode() for x in done.column("path")] or [b""], "S")[: done.num_rows]
    return found | {"name": name, "edges": np.concatenate([*edges, np.empty(0, np.int64)]), "edge_of": np.repeat(np.arange(len(edges)), [len(e) for e in edges])}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = 1, discount: float = 0.75, size_hint: int | None = None) -> dict:
    """Count all of docs and write the model; returns its spec."""
    spark = docs.sparkSession
    base = scratch_path(spark, "ngrams")
    texts = _texts(docs, id_col, text_col)
    # The number of word shards follows the bytes of the input.
    size = size_hint if size_hint is not None else (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    shards = max(1, -(-int(size) // (SHARD_TOKENS * 6)))

    step = SHARD_TOKENS

    def count_words(batches):
        for _, hashes, which, _ in _batches(batches):
            keys, counts = _count(hashes, np.bincount(which, minlength=len(hashes)))
            yield _send(keys, counts, word_shard(keys, shards))

    def build_words(table: pa.Table) -> pa.Table:
        keys, counts = _merge(table)
        shard = table.column("shard")[0].as_py()
        path = write_arrays(base, f"words-{shard}", EliasFano.build(keys, "word_") | small_counts(counts))
        # Words that are to be cut: two at most for each SHARD_TOKENS.
        heavy = np.flatnonzero(counts > step // 2)
        return _done(shard, path, len(keys), int(counts.sum()), np.column_stack([heavy, counts[heavy]]).ravel())

    spec = {"base": base, "word_shards": shards, "words": "", "pairs": "", "triples": "", "V": 0, "N": 0, "n_pairs": 0}
    done = _reduce(texts.mapInArrow(count_words, _BLOCK), build_words)
    first = np.cumsum(done["n"]) - done["n"]
    spec["V"], spec["N"] = int(done["n"].sum()), int(done["total"].sum())
    if spec["V"] >= 0xFFFFFFFF:
        raise ValueError("more than 2**32 distinct words: raise the width of pair keys")
    if not spec["N"]:
        return spec
    drop_at_exit(spark, base)
    spec["words"] = write_arrays(base, "directory-words", {"shard": done["shard"], "first": first, "name": done["name"]})

    # Pair shards: ranges of (first id, second id) with about equal numbers of tokens.
    heavy, count = done["edges"].reshape(-1, 2).T
    of = done["edge_of"].reshape(-1, 2)[:, 0]
    light = done["total"] - np.bincount(of, count, len(first)).astype(np.int64)
    starts = [np.zeros(1, np.uint64)]
    for a, n, rest in zip(first.tolist(), done["n"].tolist(), light.tolist()):
        parts = max(1, round(rest / step))
        starts.append(np.array([(a + n * k // parts) << 32 for k in range(parts)], np.uint64))
    for i, c in zip((heavy + first[of]).tolist(), count.tolist()):
        parts = max(1, -(-c // step))
        starts.append(np.array([(i << 32) + spec["V"] * k // parts for k in range(parts)] + [(i + 1) << 32], np.uint64))
    cuts = write_arrays(base, "cuts", {"from": np.unique(np.concatenate(starts))})

    def count_pairs(batches):
        trie, pair_from = opened(spec), map_arrays(base, cuts)[0]["from"]
        for _, hashes, which, counts in _batches(batches):
            ids = trie.words(hashes)[0][which]
            where = np.flatnonzero(_inner(counts))
            keys, n = _count((ids[where - 1].astype(np.uint64) << np.uint64(32)) | ids[where].astype(np.uint64))
            yield _send(keys, n, np.searchsorted(pair_from, keys, "right") - 1)

    def build_pairs(table: pa.Table) -> pa.Table:
        keys, counts = _merge(table)
        shard = table.column("shard")[0].as_py()
        keep = counts >= min_count
        keys, counts = keys[keep], counts[keep]
        first = (keys >> np.uint64(32)).astype(np.int64)
        context, lead, size = np.unique(first, return_index=True, return_counts=True)
        total = opened(spec).counts(context)
        mass = np.add.reduceat(counts - discount, lead) if len(lead) else np.empty(0)
        alpha = (counts - discount) / np.repeat(total, size)
        arrays = EliasFano.build(context, "ctx_") | lists_build(size, keys & np.uint64(0xFFFFFFFF), "next_")
        arrays |= {"alpha": quantise(alpha), "rest": quantise(1 - mass / np.maximum(total, 1))} | small_counts(counts)
        path = write_arrays(base, f"pairs-{shard}", arrays)
        ends = [0, len(context) - 1] if len(context) else []
        edges = np.array([[context[e], int(round(mass[e] * 1e6)), total[e], lead[e]] for e in ends], np.int64).ravel()
        return _done(shard, path, len(keys), int(counts.sum()), edges)

    done = _reduce(texts.mapInArrow(count_pairs, _BLOCK), build_pairs)
    pair_from = np.array(map_arrays(base, cuts)[0]["from"])
    n = np.zeros(len(pair_from), np.int64)
    n[done["shard"]] = done["n"]
    name = np.zeros(len(pair_from), done["name"].dtype)
    name[done["shard"]] = done["name"]
    n_pairs, begin = int(n.sum()), np.cumsum(n) - n
    # First words that lie in several shards; each shard names its first and its last, which may be one.
    word, mass, total, place = done["edges"].reshape(-1, 4).T
    shard = done["shard"][done["edge_of"].reshape(-1, 4)[:, 0]]
    word, shard, mass, total, place = np.unique(np.column_stack([word, shard, mass, total, begin[shard] + place]), axis=0).T
    shared, lead, often = np.unique(word, return_index=True, return_counts=True)
    rest = 1 - np.add.reduceat(mass, lead) / 1e6 / total[lead] if len(lead) else np.empty(0)
    many = often > 1
    spec = spec | {"n_pairs": n_pairs, "pairs": write_arrays(base, "directory-pairs", {"from": pair_from, "first": begin, "name": name, "shared_id": shared[many], "shared_rest": rest[many], "shared_start": place[lead][many]})}
    if not n_pairs:
        return spec

    def count_triples(batches):
        trie = opened(spec)
        for _, hashes, which, counts in _batches(batches):
            ids = trie.words(hashes)[0][which]
            at, rank, _, _, _ = trie.adjacent(ids, counts)
            # A triple seen min_count times has both its pairs in level 2.
            where = np.flatnonzero((at[1:] >= 0) & (at[:-1] >= 0)) + 1
            keys, n = _count(_triple_keys(at[where - 1], rank[where]))
            yield _send(keys, n, np.searchsorted(trie.pair_start, (keys >> RANK_BITS).astype(np.int64), "right") - 1)

    def build_triples(table: pa.Table) -> pa.Table:
        keys, counts = _merge(table)
        shard = table.column("shard")[0].as_py()
        keep = counts >= min_count
        keys, counts = keys[keep], counts[keep]
        trie = opened(spec)
        pair = (keys >> RANK_BITS).astype(np.int64) - trie.pair_start[shard]
        size = np.bincount(pair, minlength=int(trie.pair_start[shard + 1] - trie.pair_start[shard]))
        total = whole_counts(trie.open("pairs", shard)["arrays"]).astype(np.float64)
        mass = np.bincount(pair, counts - discount, len(size))
        values = keys & ((np.uint64(1) << RANK_BITS) - np.uint64(1))
        arrays = _lists_with_gaps(size, values) | {"alpha": quantise((counts - discount) / total[pair]), "rest": quantise(1 - mass / total)}
        return _done(shard, write_arrays(base, f"triples-{shard}", arrays), len(keys), int(counts.sum()), np.empty(0, np.int64))

    done = _reduce(texts.mapInArrow(count_triples, _BLOCK), build_triples)
    name = np.zeros(len(pair_from), done["name"].dtype)
    name[done["shard"]] = done["name"]
    return spec | {"triples": write_arrays(base, "directory-triples", {"name": name})}


#: Bits of a triple's key for the rank of the third word; the others number the pairs.
RANK_BITS = np.uint64(28)


def _triple_keys(pair: np.ndarray, rank: np.ndarray) -> np.ndarray:
    if int(pair.max(initial=0)) >= 1 << 36 or int(rank.max(initial=0)) >= 1 << 28:
        raise ValueError("more than 2**36 pairs or 2**28 successors: raise the width of triple keys")
    return (pair.astype(np.uint64) << RANK_BITS) | rank.astype(np.uint64)


def _lists_with_gaps(size: np.ndarray, values: np.ndarray) -> dict[str, np.ndarray]:
    """lists_build where lists may be empty: an empty list reaches nothing."""
    full = np.flatnonzero(size)
    ends = np.cumsum(size)
    tops = np.zeros(len(size), np.uint64)
    tops[full] = values[ends[full] - 1] + np.uint64(1)
    base = np.concatenate(([np.uint64(0)], np.cumsum(tops, dtype=np.uint64)))
    return EliasFano.build(np.concatenate(([0], ends)), "next_ptr_") | EliasFano.build(values + np.repeat(base[:-1], size), "next_val_") | EliasFano.build(base, "next_base_")


def score(docs: DataFrame, spec: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for every row."""

    def run(batches):
        trie = opened(spec)
        V, N = spec["V"], spec["N"]
        for ids, hashes, which, counts in _batches(batches):
            word, c = trie.words(hashes)
            p1 = (c + 1) / (N + V + 1)
            word, known, base, p1 = (x[which] for x in (word, (c > 0).astype(np.int64), np.log10(p1), p1))
            at, rank, alpha2, rest2, inner = trie.adjacent(word, counts)
            p2 = alpha2 + rest2 * p1
            p = p2.copy()
            # Where the pair before is in level 2, mix in the triple; its key exists only if its own pair does.
            where = np.flatnonzero(at[:-1] >= 0) + 1
            where = where[inner[where]]
            if len(where) and spec["triples"]:
                pair = at[where - 1]
                order = np.argsort(pair)
                alpha3, rest3 = trie.triples(pair[order], rank[where[order]])
                p[where[order]] = alpha3 + rest3 * p2[where[order]]
            cut = np.concatenate(([0], np.cumsum(counts)[:-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(np.add.reduceat(known, cut)), pa.array(np.add.reduceat(base, cut)), pa.array(np.add.reduceat(np.log10(p), cut))],
                ["id", "n_tokens", "n_known", "base_score", "score"],
            )

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double")


def op3_lm_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the model of those whose crc32 remainder by 7 is not 2."""
    docs = documents(spark, sf_dir)
    spec = train(docs.where(crc_bucket("doc_id", 7) != 2), min_count=1)
    found = score(docs, spec).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (crc_bucket("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(spec["N"]).cast("long").alias("train_tokens"), "base_score", "score")
