"""Phrase collocations from Rabin-Karp fingerprints of word n-grams.

Texts of a block lie end to end as bytes; prefix sums of byte times power, modulo 2**64, give every word's fingerprint, and
prefix sums over the words give that of every n-gram, all in numpy. Two passes over the texts:
  1. all n-grams are counted by the low SIEVE_BITS of their fingerprints; those that occur often enough go into a bit table of a
     fixed size, which all tasks get. It may let more through as data grow past its size, never less.
  2. n-grams that pass are summed by fingerprint, each with a pointer (row, place) to an occurrence, and the least
     and greatest of a second fingerprint to other bases.
Both send sorted blocks to shards of fingerprints, as compressed gaps and counts, so what is sent is in proportion to the texts.
Then the pointers of the frequent fingerprints go to their texts, and there the phrases are read; no other phrase is
ever written out. Where the second fingerprints differ, different phrases have met in one fingerprint: those are counted
once more by their text, with every occurrence compared byte for byte. A phrase of `least` occurrences has a fingerprint
with as many, and so have its parts, so nothing is lost. Blocks sum before they send.

Scores, containment and ranks are joins and sums over the frequent phrases. Ranks come from range partitions and their sizes,
since one language may hold most phrases. Products are decimals of 38 digits.

Defined results: null texts are empty; a null language is `und`; repeated rows count as often as they are there; ties go by score, then
frequency, then the phrase's bytes; an empty table gives an empty result; extra columns are ignored. Very long texts are cut
into blocks at the ends of pieces, so a block is some `BLOCK` bytes, or as long as its longest piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, discard, documents, materialize, release, with_release

LONGEST, LEAST, CONTAINED, FIRST = 4, 30, 80, 2000
SCALE = 2_000_000
#: Bytes of text that are hashed together, and rows that a task holds before it sums them.
BLOCK, HELD = 2 << 20, 1_000_000
#: Bits of a fingerprint that the first pass counts; the count is kept below them, and goes up to its greatest number. N-grams that
#: a task holds before it sums them, and bytes of text to a shard of fingerprints, some 9 million n-grams.
SIEVE_BITS, COUNT_BITS, TALLIES, SHARD_BYTES = 40, 24, 4_000_000, 12_000_000
#: Bound of a bit table that is sent to all tasks: 2**28 bits are 32 MB.
MOST_BITS = 28
UNKNOWN = "und"

#: Bases of the polynomials over bytes and over words, of the first and of the second fingerprint.
_BASES = [tuple(np.uint64(x) for x in pair) for pair in ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB))]
_SIEVE, _COUNT, _SHIFT = np.uint64((1 << SIEVE_BITS) - 1), np.uint64((1 << COUNT_BITS) - 1), np.uint64(COUNT_BITS)
_TURN = np.uint64(0xBF58476D1CE4E5B9)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
_END = re.compile(rb"[.,;:!?\n\v\f\r]")
_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a sum over all bits; one-to-one."""
    h = (h ^ (h >> np.uint64(31))) * _TURN
    return h ^ (h >> np.uint64(29))


def _prefixes(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of value times power of the base, and the inverse powers: (up[b] - up[a]) * down[a] is the polynomial of a to b."""
    up = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(base, len(values)), dtype=np.uint64)))
    return up, _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(values) + 1)


class Block:
    """Words of some texts, each text closed by a piece's end: bytes, starts, ends, pieces, texts, languages and fingerprints.
    width: bits of the first fingerprint; `skipped`: words of the (only) text that lie before this block."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, seeds: np.ndarray, width: int = 64, skipped: int = 0):
        self.raw = _LOW[np.frombuffer(b"\n".join(texts), np.uint8)]
        kind = _CLASS[self.raw]
        edge = np.diff(np.concatenate(([0], (kind == 0).view(np.int8), [0])))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == 2)[self.start] if len(self.raw) else self.start
        closes = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(closes, self.start, "right")
        self.lang = langs[self.text] if len(self.text) else self.text
        self.first = np.searchsorted(self.start, np.concatenate(([0], closes[:-1])))
        self.skipped, self.mask = skipped, np.uint64((1 << width) - 1)
        self.place = skipped + np.arange(len(self.start)) - self.first[self.text] if len(self.text) else self.text
        self.seed = seeds[self.text] if len(self.text) else self.text.astype(np.uint64)
        self.over_words: list = [None, None]

    def _polynomials(self, which: int, at: np.ndarray, k: int) -> np.ndarray:
        if self.over_words[which] is None:
            byte, word = _BASES[which]
            up, down = _prefixes(self.raw, byte)
            words = _mixed((up[self.end] - up[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
            self.over_words[which] = _prefixes(words, word)
        up, down = self.over_words[which]
        return _mixed((up[at + k] - up[at]) * down[at] + self.seed[at] + np.uint64(k))

    def grams(self, k: int) -> np.ndarray:
        """First words of the n-grams of k words inside one piece."""
        n = len(self.start) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.empty(0, np.int64)

    def prints(self, at: np.ndarray, k: int) -> np.ndarray:
        """Fingerprints of the n-grams of k words at `at`, apart by language and length."""
        return self._polynomials(0, at, k) & self.mask

    def checks(self, at: np.ndarray, k: int) -> np.ndarray:
        """The second fingerprints."""
        return self._polynomials(1, at, k)

    def phrase(self, at: int, k: int) -> bytes:
        return b" ".join(self.raw[self.start[i] : self.end[i]].tobytes() for i in range(at, at + k))

    def same_text(self, at: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
        """Whether the n-grams at two places have the same language and the same bytes, word for word."""
        ok = self.lang[at] == self.lang[other]
        for j in range(k):
            a, b = self.start[at + j], self.start[other + j]
            size = self.end[at + j] - a
            ok &= size == self.end[other + j] - b
            live = np.flatnonzero(ok)
            step = 0
            # One byte of all words that are still open at a time: as many rounds as the longest word has bytes.
            while len(live := live[size[live] > step]):
                same = self.raw[a[live] + step] == self.raw[b[live] + step]
                ok[live[~same]] = False
                live, step = live[same], step + 1
        return ok


def _cut(text: bytes) -> list[bytes]:
    """A text in parts of some BLOCK bytes, cut behind piece ends."""
    out, at = [], 0
    while len(text) - at > BLOCK and (end := _END.search(text, at + BLOCK)):
        out.append(text[at : end.end()])
        at = end.end()
    return [*out, text[at:]]


def blocks(batches: Iterator[pa.RecordBatch], width: int = 64) -> Iterator[tuple[Block, list[str], pa.RecordBatch]]:
    """Blocks of batches (key, lang, text, ...), with the names of their languages and the rows they are of."""
    for part in byte_slices(batches, 2, BLOCK):
        names = [UNKNOWN if x is None else x for x in part.column(1).to_pylist()]
        known = sorted(set(names))
        langs = np.array([known.index(x) for x in names], np.int64)
        seeds = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in known], np.uint64)[langs]
        texts = [t.as_py() or b"" for t in part.column(2)]
        if len(texts) > 1:
            yield Block(texts, langs, seeds, width), known, part
            continue
        words = 0
        for piece in _cut(texts[0]):
            block = Block([piece], langs, seeds, width, words)
            words += len(block.start)
            yield block, known, part


def _leads(ordered: np.ndarray) -> np.ndarray:
    """Where values that are new begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1])))


class Held:
    """Columns of rows, the first of them fingerprints, that a task sums whenever there are more than `most`, and sends on
    where the sums are not much fewer."""

    def __init__(self, columns: int, most: int, merge, send):
        self.columns, self.most, self.merge, self.send = columns, most, merge, send
        self.parts: list[tuple[np.ndarray, ...]] = []

    def _merged(self) -> tuple[np.ndarray, ...]:
        kinds = [np.uint64, *[np.int64] * (self.columns - 1)]
        whole = [np.concatenate([*(p[i] for p in self.parts), np.empty(0, t)]) for i, t in enumerate(kinds)]
        self.parts.clear()
        return self.merge(whole)

    def add(self, *rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(rows)
        if sum(len(p[0]) for p in self.parts) > self.most:
            found = self._merged()
            if len(found[0]) > self.most // 2:
                yield self.send(found)
            else:
                self.parts.append(found)

    def rest(self) -> pa.RecordBatch:
        return self.send(self._merged())


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers by planes of bytes, most of which are zero."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), 1)


def _unpack(block: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(block), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view(np.uint64).ravel() for c in raw]


def _by_shard(shard: np.ndarray, pack) -> pa.RecordBatch:
    """One block for each run of equal shards: what `pack` makes of its first and last row."""
    cut = np.append(_leads(shard), len(shard)).tolist()
    blocks = [pack(a, b) for a, b in zip(cut, cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]].astype(np.int64)), pa.array(blocks, pa.binary())], ["shard", "block"])


_BLOCKS = "shard long, block binary"


def _gaps(prints: np.ndarray) -> np.ndarray:
    return np.diff(prints, prepend=np.uint64(0))


def _tallied(tallies: np.ndarray) -> np.ndarray:
    """Short fingerprints, each above its count, in order: one for each fingerprint."""
    tallies.sort()
    prints = tallies >> _SHIFT
    lead = _leads(prints)
    n = np.add.reduceat(tallies & _COUNT, lead) if len(lead) else tallies
    return (prints[lead] << _SHIFT) | np.minimum(n, _COUNT)


def _occurrences(columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(fingerprints, n, low, high, k, key, place): one row for each fingerprint, with the sum of n, the least low, the greatest
    high, and the occurrence of least key and then least place."""
    order = np.lexsort((columns[6], columns[5], columns[0]))
    prints, n, low, high, k, key, place = (c[order] for c in columns)
    lead = _leads(prints)
    over = lambda f, x: f.reduceat(x, lead) if len(x) else x
    return prints[lead], over(np.add, n), over(np.minimum, low), over(np.maximum, high), k[lead], key[lead], place[lead]


def sieved(prints: np.ndarray) -> np.ndarray:
    """What stands for fingerprints in the bit table of the first pass: their low bits, spread."""
    return _mixed(prints & _SIEVE)


class Bits:
    """A table of bits: two for each fingerprint that was put in."""

    def __init__(self, words: np.ndarray):
        self.words, self.width = words, int(np.log2(len(words) * 64))

    @staticmethod
    def places(prints: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return (prints >> np.uint64(64 - width)).astype(np.int64), (prints & np.uint64((1 << width) - 1)).astype(np.int64)

    def passes(self, prints: np.ndarray) -> np.ndarray:
        out = np.ones(len(prints), bool)
        for at in self.places(prints, self.width):
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
        return out


def bit_table(frequent: DataFrame, most_bits: int = MOST_BITS) -> Bits:
    """The fingerprints of column `print` as bits: 32 bits for each, 2**most_bits at most."""
    count = frequent.count()
    width = min(most_bits, max(12, int(32 * max(count, 1)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(Bits.places(batch.column(0).to_numpy().view(np.uint64), width)) if batch.num_rows else np.empty(0, np.int64)
            order = np.sort(at)
            lead = _leads(order >> 6)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (order & 63).astype(np.uint64), lead) if len(order) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(order[lead] >> 6), pa.array(bits.view(np.int64))], ["at", "bits"])

    # At most 2**most_bits / 64 rows.
    found = frequent.select("print").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (width - 6), np.uint64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Bits(words)


def _texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(key, lang, text as bytes, row); rows with the same key are the same, but for what a check of the text finds out."""
    row, text, lang = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{lang_col}`").cast("string")
    return docs.select(F.xxhash64(row, lang, text).alias("key"), lang.alias("lang"), F.encode(text, "UTF-8").alias("text"), row.alias("row"))


def shard_count(texts: DataFrame) -> int:
    """Shards of fingerprints: as the bytes of the texts."""
    return max(1, -(-int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))


def short_prints(texts: DataFrame, shards: int, longest: int = LONGEST, least: int = LEAST, width: int = 64) -> DataFrame:
    """(print) of all words and n-grams whose short fingerprints occur `least` times, as `sieved` gives it."""
    enough = np.uint64(min(least, int(_COUNT)))

    def send(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        (tallies,) = found
        prints = tallies >> _SHIFT
        return _by_shard(prints * np.uint64(shards) >> np.uint64(SIEVE_BITS), lambda a, b: _pack([(_gaps(prints[a:b]) << _SHIFT) | (tallies[a:b] & _COUNT)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(1, TALLIES, lambda columns: (_tallied(columns[0]),), send)
        for block, _, _ in blocks(batches, width):
            for k in range(1, longest + 1):
                yield from held.add(((block.prints(block.grams(k), k) & _SIEVE) << _SHIFT) | np.uint64(1))
        yield held.rest()

    def often(table: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py(), 1)[0] for x in table.column("block")]
        tallies = _tallied(np.concatenate([(np.cumsum(x >> _SHIFT, dtype=np.uint64) << _SHIFT) | (x & _COUNT) for x in parts]))
        found = sieved(tallies[(tallies & _COUNT) >= enough] >> _SHIFT)
        del parts, tallies
        release()
        return pa.table({"print": pa.array(found.view(np.int64))})

    return texts.mapInArrow(with_release(run), _BLOCKS).groupBy("shard").applyInArrow(often, "print long")


def _candidates(block: Block, short: Bits, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, first words) of the n-grams that pass; their parts do, too."""
    good = np.ones(len(block.start) + 1, bool)
    for k in range(1, longest + 1):
        at = block.grams(k)
        at = at[good[at] & good[at + 1]] if k > 1 else at
        at = at[short.passes(sieved(block.prints(at, k)))]
        yield k, at
        good = np.zeros(len(block.start) + 1, bool)
        good[at] = True


def gram_prints(texts: DataFrame, short: Bits, shards: int, longest: int = LONGEST, width: int = 64) -> DataFrame:
    """(print, n, alike, k, key, place) of the n-grams that pass. (key, place) is an occurrence in
    the row of least key, k its number of words; alike: all occurrences have the same second fingerprint."""
    shared = texts.sparkSession.sparkContext.broadcast(short)

    def send(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        prints, n, low, high, *rest = found
        shard = (prints >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        return _by_shard(shard, lambda a, b: _pack([_gaps(prints[a:b]), n[a:b], low[a:b], low[a:b] ^ high[a:b], *(c[a:b] for c in rest)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(7, HELD, _occurrences, send)
        for block, _, part in blocks(batches, width):
            keys = part.column(0).to_numpy(zero_copy_only=False)
            for k, at in _candidates(block, shared.value, longest):
                prints, checks = block.prints(at, k), block.checks(at, k).view(np.int64)
                # By fingerprint, then by second fingerprint: a row for each pair of them that is there.
                order = np.lexsort((checks, prints))
                prints, checks, at = prints[order], checks[order], at[order]
                lead = np.flatnonzero(np.concatenate((np.ones(min(len(at), 1), bool), (prints[1:] != prints[:-1]) | (checks[1:] != checks[:-1]))))
                # The order is stable, so the first occurrence in the block leads.
                first, check = at[lead], checks[lead]
                yield from held.add(prints[lead], np.diff(np.append(lead, len(at))), check, check, np.full(len(lead), k), keys[block.text[first]], block.place[first])
        yield held.rest()

    def summed(table: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py(), 7) for x in table.column("block")]
        for p in parts:
            p[0], p[3] = np.cumsum(p[0], dtype=np.uint64), p[2] ^ p[3]
        prints, *rest = (np.concatenate([p[i] for p in parts]) for i in range(7))
        prints, n, low, high, k, key, place = _occurrences([prints, *(c.view(np.int64) for c in rest)])
        out = pa.table({"print": prints.view(np.int64), "n": n, "alike": low == high, "k": k, "key": key, "place": place})
        del parts, rest
        release()
        return out

    return texts.mapInArrow(with_release(run), _BLOCKS).groupBy("shard").applyInArrow(summed, "print long, n long, alike boolean, k long, key long, place long")


_PHRASE = "print long, lang string, k int, phrase binary, row long, place long"


def pointed_phrases(texts: DataFrame, prints: DataFrame, width: int = 64, most_bits: int = MOST_BITS) -> DataFrame:
    """prints (print, k, key, place, ...) -> (print, lang, k, phrase, pointer): what stands where the pointers lead to."""
    wanted = prints.groupBy("key").agg(F.collect_list(F.struct("print", "k", "place")).alias("wanted"))
    rows = texts.sparkSession.sparkContext.broadcast(bit_table(prints.select(F.col("key").alias("print")).distinct(), most_bits))

    def pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) if batch.num_rows else np.empty(0, np.uint64)
            yield batch.filter(pa.array(rows.value.passes(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, names, part in blocks(batches, width):
            lists, ids = part.column(4), part.column(3).to_pylist()
            ends = lists.offsets.to_numpy()
            text = np.repeat(np.arange(len(ids)), np.diff(ends))
            inner = lists.values.slice(ends[0], ends[-1] - ends[0])
            sought, k, place = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = block.first[text] + place - block.skipped
            # Those of this block whose fingerprint is the one that was sought.
            here = np.flatnonzero((at >= block.first[text]) & (at + k <= len(block.start)))
            hit = np.zeros(len(here), bool)
            for size in np.unique(k[here]).tolist():
                of = np.flatnonzero(k[here] == size)
                a = at[here[of]]
                hit[of] = (block.piece[a] == block.piece[a + size - 1]) & (block.prints(a, size).view(np.int64) == sought[here[of]]) & (block.text[a] == text[here[of]])
            found = here[hit]
            cells = [(int(sought[i]), names[block.lang[at[i]]], int(k[i]), block.phrase(int(at[i]), int(k[i])), ids[text[i]], int(place[i])) for i in found.tolist()]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate(kinds)], ["print", "lang", "k", "phrase", "row", "place"])

    joined = texts.mapInArrow(with_release(pointed), texts.schema).join(wanted, "key").select("key", "lang", "text", "row", "wanted")
    # Repeated rows read the same phrase more than once.
    return joined.mapInArrow(with_release(run), _PHRASE).dropDuplicates(["print"]).select("print", "lang", "k", "phrase", F.struct("row", "place").alias("pointer"))


def phrase_counts(texts: DataFrame, short: Bits, some: Bits, longest: int = LONGEST, width: int = 64) -> DataFrame:
    """(print, lang, k, phrase, n, pointer) of the n-grams whose fingerprints are in `some`, by their text. Occurrences are
    compared byte for byte with the first of their fingerprint; those that differ are compared among themselves, and so on."""
    context = texts.sparkSession.sparkContext
    first, second = context.broadcast(short), context.broadcast(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}

        def send() -> pa.RecordBatch:
            rows = [(*key, *found) for key, found in held.items()]
            held.clear()
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["print", "lang", "k", "phrase", "row", "place", "n"])

        for block, names, part in blocks(batches, width):
            ids = part.column(3).to_pylist()
            for k, at in _candidates(block, first.value, longest):
                prints = block.prints(at, k)
                passed = second.value.passes(prints)
                at, prints = at[passed], prints[passed]
                while len(at):
                    order = np.argsort(prints, kind="stable")
                    at, prints = at[order], prints[order]
                    lead = _leads(prints)
                    same = block.same_text(at, np.repeat(at[lead], np.diff(np.append(lead, len(at)))), k)
                    for i, x, n in zip(at[lead].tolist(), prints[lead].view(np.int64).tolist(), np.add.reduceat(same.astype(np.int64), lead).tolist()):
                        key = (x, names[block.lang[i]], k, block.phrase(i, k))
                        old = held.get(key)
                        held[key] = (ids[block.text[i]], int(block.place[i]), n) if old is None else (*old[:2], old[2] + n)
                    at, prints = at[~same], prints[~same]
            if len(held) > HELD // 4:
                yield send()
        yield send()

    found = texts.mapInArrow(with_release(run), _PHRASE + ", n long")
    return found.groupBy("print", "lang", "k", "phrase").agg(F.sum("n").alias("n"), F.min(F.struct("row", "place")).alias("pointer"))


def word_totals(texts: DataFrame) -> DataFrame:
    """(lang, total): all word occurrences of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        for block, names, _ in blocks(batches):
            for name, n in zip(names, np.bincount(block.lang, minlength=len(names)).tolist()):
                totals[name] = totals.get(name, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["lang", "total"])

    return texts.mapInArrow(with_release(run), "lang string, total long").groupBy("lang").agg(F.sum("total").alias("total"))


def frequent_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, most_bits: int = MOST_BITS, width: int = 64) -> DataFrame:
    """(lang, k, phrase, a, pointer) of all phrases of 1 to `longest` words with `least` occurrences."""
    texts = _texts(docs, id_col, text_col, lang_col)
    shards = shard_count(texts)
    frequent = materialize(short_prints(texts, shards, longest, least, width), "short")
    short = bit_table(frequent, most_bits)
    discard(frequent)
    prints = materialize(gram_prints(texts, short, shards, longest, width).where(F.col("n") >= least), "prints")
    read = pointed_phrases(texts, prints.where("alike"), width, most_bits)
    found = read.join(prints.where("alike").select("print", F.col("n").alias("a")), "print").select("lang", "k", "phrase", "a", "pointer")
    mixed = prints.where("not alike").select("print")
    if not mixed.isEmpty():
        counted = phrase_counts(texts, short, bit_table(mixed, most_bits), longest, width).where(F.col("n") >= least)
        found = found.union(counted.join(mixed, "print").select("lang", "k", "phrase", F.col("n").alias("a"), "pointer"))
    out = materialize(found.withColumn("phrase", F.decode("phrase", "UTF-8")), "phrases")
    discard(prints)
    return out


def _part(words: Column, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, pointer, l, r, score) of the phrases of two words or more, by their lowest cut; ties to the smallest."""
    known = phrases.select("lang", "phrase", "a")
    words = F.split("phrase", " ")
    cuts = phrases.where("k > 1").select("lang", "phrase", "k", "a", "pointer", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": _part(words, 1, F.col("cut")), "right": _part(words, F.col("cut") + 1, F.col("k"))})
    for side, out in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("a").alias(out)), ["lang", side])
    score = F.expr(f"{SCALE}BD * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a", "pointer").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return lowest.select("lang", "phrase", "k", "a", "pointer", "low.l", "low.r", "low.score")


def not_contained(phrases: DataFrame, candidates: DataFrame, share: int = CONTAINED) -> DataFrame:
    """candidates without those inside a longer phrase with `share` percent of their occurrences or more."""
    words = F.split("phrase", " ")
    sizes = F.when(F.col("k") > 2, F.sequence(F.lit(2), F.col("k") - 1)).otherwise(F.array().cast("array<int>"))
    inside = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda at: _part(words, at, n))))
    longer = phrases.where("k > 2").select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), F.col("a").alias("outer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = F.col("outer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("outer") < F.lit(share).cast("decimal(20,0)") * F.col("a"))
    return candidates.join(most, ["lang", "phrase"], "left").where(kept).drop("outer")


def ranked(rows: DataFrame, first: int = FIRST) -> DataFrame:
    """rows with their rank by language, the first ones of each. Range partitions of the order are written once; the sizes of
    each language's share in the partitions before give a row's rank, so no task holds a whole language."""
    order = [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")]
    dealt = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftrightunsigned("at", 33)
    # A row for each partition and each language in it.
    sizes = dealt.groupBy("lang", part.alias("part")).agg(F.count("*").alias("size"), F.min("at").alias("low"))
    before = sizes.select("lang", "part", "low", (F.sum("size").over(Window.partitionBy("lang").orderBy("part")) - F.col("size")).alias("before"))
    found = dealt.withColumn("part", part).join(before.where(F.col("before") < first), ["lang", "part"])
    return found.withColumn("rank", F.col("before") + F.col("at") - F.col("low") + 1).where(F.col("rank") <= first).drop("at", "part", "low", "before")


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = CONTAINED, first: int = FIRST, most_bits: int = MOST_BITS, width: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first phrases of every language, with the document and the word of an
    occurrence. width: bits of the fingerprints that are summed; with fewer, more of them collide and are told apart by text."""
    phrases = frequent_phrases(docs, id_col, text_col, lang_col, longest, least, most_bits, width)
    totals = word_totals(_texts(docs, id_col, text_col, lang_col)).withColumnRenamed("total", "n")
    best = ranked(not_contained(phrases, scored(phrases), share), first)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score", F.col("pointer.row").alias("doc_id"), F.col("pointer.place").alias("word"))


def op13_collocations_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language of the documents."""
    return collocations(documents(spark, sf_dir)).drop("doc_id", "word")


OP13_SQL = f"""WITH pieces AS (SELECT lang, regexp_extract_all(pieces[p], '[^\\x20\\x09]+') AS words FROM (
 SELECT coalesce(lang, '{UNKNOWN}') AS lang, pieces, unnest(range(1, len(pieces) + 1)) AS p FROM (
  SELECT lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents) p0) p1),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
grams AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM starts, range(1, {LONGEST + 1}) r(k) WHERE i + k - 1 <= len(words)),
known AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
totals AS (SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, cut, string_split(c.phrase, ' ') AS w FROM known c, range(1, {LONGEST}) r(cut) WHERE cut < c.k),
scored AS (SELECT c.lang, c.k, c.phrase, c.a, x.a AS l, y.a AS r, ({SCALE}::HUGEINT * c.a) // (x.a + y.a) AS score, cut
 FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN known y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (SELECT lang, a, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT lang, k, a, string_split(phrase, ' ') AS w FROM known WHERE k > 2) z, range(2, {LONGEST}) s(n), range(1, {LONGEST}) t(i) WHERE n < k AND i + n - 1 <= k),
outer_most AS (SELECT lang, phrase, max(a) AS outer_a FROM inner_parts GROUP BY ALL),
kept AS (SELECT l.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest l LEFT JOIN outer_most USING (lang, phrase) WHERE outer_a IS NULL OR 100 * outer_a < {CONTAINED} * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept JOIN totals USING (lang) WHERE rank <= {FIRST}"""
