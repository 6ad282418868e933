"""Token ids in compressed binary blocks: an adaptive context-mixing range coder.

The ids of a row of documents are those of its units, the pieces that texts are cut into before they are encoded. A row keeps each
distinct unit's ids once, and the sequence of units is coded; where units hardly recur, the ids are coded themselves.

Each block is coded on its own: models start empty, and a checksum closes it. A symbol's interval comes
from a mixture of predictions: what last followed the previous two (order 2) and the previous one (order 1), and counts of all
symbols, one more for each (order 0). Weights follow the record of hits of orders 2 and 1, in cells by how
often a context was seen and by the share of what last followed it: order 2 first, order 1 by its record where order 2 missed.
A symbol is coded by the largest interval that stands for it.

To run as array operations, a block is dealt to lanes, each with a range coder and a contiguous share of the
symbols; lanes share the block's models, which learn at steps 1, 4, 16, ... from all steps before. Arithmetic is on integers, so
files do not depend on the machine.

Blocks are rows of a table that Spark writes and commits, as are the ids and lengths of the documents they
hold, so a lost executor costs a task and readers need no shared mount. A row holds whole documents.

Defined results: null and empty texts are just the end id; an added token of the vocabulary that stands in a
text gets its id, as the library gives it; repeated rows are written like others; rows of equal ids are written
in the order of their texts; documents without an id sort first; an empty table gives an empty table of blocks;
extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, bytes_of, documents, materialize, shuffle_partitions, with_release

#: Symbols in a block, more or less; lanes of a block, and the least steps of many; steps whose intervals are found together.
BLOCK = 1_800_000
MAX_LANES, MIN_STEPS = 2048, 512
TOGETHER = 64
MAGIC = b"HCM3"
#: magic, symbols, vocabulary, lanes, CRC-32 of the symbols, 16-bit words of payload, steps.
HEAD = struct.Struct("<4sIIIIII")
#: CRC-32 of the rest, number of units, number of ids.
UNITS = struct.Struct("<III")
TOTAL_BITS = 24
_TOTAL = 1 << TOTAL_BITS
#: What orders 1 and 2 have at most; the rest is more than a block has symbols and a vocabulary ids.
_ROOM = _TOTAL // 8 * 7
_MOST_VOCABULARY = 1 << 18
_HASH_BITS = 16
_WEIGHT_BITS = 16
#: Level of a context by how often it was seen; a cell is a level and a quarter.
_LEVEL = 4 * np.array([0, 1, 2, 3, 3, 4, 4, 4, 4, 5])
_CELLS = 24
#: Units that a worker keeps the ids of, and bytes of them.
UNIT_MEMORY, UNIT_BYTES = 1_500_000, 64 << 20
#: Units that the library encodes as one text.
TEXT = 200
#: Kinds of bytes: letters, marks, others, line ends, other white space and control characters.
_LETTER, _MARK, _OTHER, _LINE, _WHITE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[: 0x21], _KIND[0x7F], _KIND[0x0A] = _WHITE, _WHITE, _LINE
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = _MARK
_KIND[[c for c in range(0x21, 0x7F) if chr(c).isalpha()]] = _LETTER


class _Followers:
    """What followed each context last, and how often it was that."""

    def __init__(self, contexts: int):
        self.last, self.seen, self.same = (np.zeros(contexts, np.int64) for _ in range(3))
        self.cell, self.tries, self.hits = np.zeros(contexts, np.int64), np.full(_CELLS, 4, np.int64), np.full(_CELLS, 2, np.int64)
        self.table = np.zeros(contexts, np.int64)

    def record(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Count whether contexts told what followed; returns where they did not."""
        cell = self.cell[at]
        hit = (self.last[at] == x) & (cell > 3)
        self.tries += np.bincount(cell, minlength=_CELLS)
        self.hits += np.bincount(cell[hit], minlength=_CELLS)
        return ~hit

    def learn(self, at: np.ndarray, x: np.ndarray) -> None:
        before = self.last.copy()
        self.last[at] = x
        self.same[self.last != before] = 0
        self.seen += np.bincount(at, minlength=len(self.seen))
        self.same += np.bincount(at[self.last[at] == x], minlength=len(self.seen))
        self.cell = _LEVEL[np.minimum(self.seen, len(_LEVEL) - 1)] + 3 * self.same // np.maximum(self.seen, 1)
        weight = (self.hits << _WEIGHT_BITS) // (self.tries + 1)
        weight[:4] = 0
        #: For each context its weight, and below it what followed last.
        self.table = (weight[self.cell] << 32) | self.last


class _Mixture:
    """The models of one block."""

    def __init__(self, lanes: int, steps: int, vocabulary: int):
        self.V = vocabulary
        self.one, self.two = _Followers(vocabulary + 1), _Followers(1 << _HASH_BITS)
        #: All symbols by step, behind two steps of no symbol.
        self.past = np.full((steps + 2, lanes), vocabulary, np.int64)
        self.counts, self.learnt = np.ones(vocabulary, np.int64), 0
        self._order_0()

    def _order_0(self) -> None:
        self.cum = np.concatenate(([0], np.cumsum(self.counts)))
        self.N = int(self.cum[-1])
        #: Symbols in order, as often as they count: the inverse of the cumulative counts.
        self.ordered = np.repeat(np.arange(self.V, dtype=np.int32), self.counts)

    def _contexts(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Of steps a to b: order 1, and order 2 as a hash."""
        one, two = self.past[a + 1 : b + 1], self.past[a:b]
        return one, ((one * 0x9E3779B1 + two * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - _HASH_BITS)

    def learn(self, step: int) -> None:
        """Take in the steps before this one."""
        x = self.past[self.learnt + 2 : step + 2].ravel()
        one, two = (c.ravel() for c in self._contexts(self.learnt, step))
        missed = self.two.record(two, x)
        self.one.record(one[missed], x[missed])
        self.two.learn(two, x)
        self.one.learn(one, x)
        self.counts += np.bincount(x, minlength=self.V)
        self.learnt = step
        self._order_0()

    def predict(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Of steps a to b: what orders 2 and 1 say, and their shares of _TOTAL."""
        one, two = self._contexts(a, b)
        said2, said1 = self.two.table[two], self.one.table[one]
        share2 = (said2 >> 32) * _ROOM >> _WEIGHT_BITS
        share1 = (said1 >> 32) * (_ROOM - share2) >> _WEIGHT_BITS
        return said2 & 0xFFFFFFFF, said1 & 0xFFFFFFFF, share2, share1

    def intervals(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) among _TOTAL of the symbols of steps a to b: the largest of the intervals that stand for each."""
        said2, said1, share2, share1 = self.predict(a, b)
        x, named = self.past[a + 2 : b + 2], share2 + share1
        rest = _TOTAL - named
        start = self.cum[x] * rest // self.N
        size = self.cum[x + 1] * rest // self.N - start
        start += named
        for said, share, at in ((said1, share1, share2), (said2, share2, np.int64(0))):
            more = (said == x) & (share > size)
            start, size = np.where(more, at, start), np.where(more, share, size)
        return start, size

    def lookup(self, step: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, start, size) of the interval that holds v."""
        said2, said1, share2, share1 = (c[0] for c in self.predict(step, step + 1))
        named = share2 + share1
        second = v < share2
        x, start, size = np.where(second, said2, said1), np.where(second, 0, share2), np.where(second, share2, share1)
        m = np.flatnonzero(v >= named)
        if len(m):
            base = named[m]
            rest = _TOTAL - base
            found = self.ordered[((v[m] - base + 1) * self.N - 1) // rest].astype(np.int64)
            low = self.cum[found] * rest // self.N
            x[m], start[m], size[m] = found, base + low, self.cum[found + 1] * rest // self.N - low
        return x, start, size


def _learns(step: int) -> bool:
    return step > 0 and step & (step - 1) == 0 and step.bit_length() % 2 == 1


def _lanes(n: int) -> int:
    return max(1, min(MAX_LANES, n // MIN_STEPS))


def encode_blocks(ids: np.ndarray, vocabulary: int, sizes: np.ndarray | None = None) -> list[bytes]:
    """ids: (blocks, n) -> one self-contained block of bytes for each row; sizes: ids of each row that count."""
    if not 0 < vocabulary <= _MOST_VOCABULARY:
        raise ValueError(f"vocabularies have 1 to {_MOST_VOCABULARY} ids")
    return [_encode(row if sizes is None else row[: sizes[k]], vocabulary) for k, row in enumerate(ids)]


def _encode(ids: np.ndarray, vocabulary: int) -> bytes:
    n = len(ids)
    if n + MAX_LANES + vocabulary > _TOTAL - _ROOM:
        raise ValueError(f"a block and its vocabulary have {_TOTAL - _ROOM - MAX_LANES} ids at most: pack() cuts longer runs")
    lanes = _lanes(n)
    steps = -(-n // lanes)
    padded = np.zeros(lanes * steps, np.int64)
    padded[:n] = ids
    model = _Mixture(lanes, steps, vocabulary)
    model.past[2:] = padded.reshape(lanes, steps).T
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
    width = 2 * steps + 8
    out, pos = np.zeros(lanes * width, np.int64), np.arange(lanes) * width + 1
    shift, mask48, mask32 = np.uint64(TOTAL_BITS), np.uint64((1 << 48) - 1), np.uint64((1 << 32) - 1)
    t = end = 0
    for t in range(steps):
        if _learns(t):
            model.learn(t)
        if t == end:
            begin, end = t, min(steps, t + TOGETHER, 1 << t.bit_length())
            starts, spans = (c.astype(np.uint64) for c in model.intervals(begin, end))
        r = span >> shift
        low += starts[t - begin] * r
        span = spans[t - begin] * r
        carry = np.flatnonzero(low > mask48)
        if len(carry):
            out[pos[carry] - 1] += 1
            low &= mask48
        for _ in range(2):
            m = np.flatnonzero(span <= mask32)
            if not len(m):
                break
            some, at = low[m], pos[m]
            out[at] = (some >> np.uint64(32)).view(np.int64)
            pos[m] = at + 1
            low[m] = (some & mask32) << np.uint64(16)
            span[m] <<= np.uint64(16)
    for k in (32, 16, 0):
        out[pos] = ((low >> np.uint64(k)) & np.uint64(0xFFFF)).astype(np.int64)
        pos += 1
    out, pos = out.reshape(lanes, width), pos - np.arange(lanes) * width
    # Carries go left; the first word is there to take one that never comes.
    while (over := np.flatnonzero(out > 0xFFFF)).size:
        flat = out.reshape(-1)
        carry = flat[over] >> 16
        flat[over] &= 0xFFFF
        flat[over - 1] += carry
    kept = np.arange(width) < pos[:, None]
    kept[:, 0] = False
    words = out[kept].astype("<u2")
    return HEAD.pack(MAGIC, n, vocabulary, lanes, zlib.crc32(ids.astype("<u4").tobytes()), len(words), steps) + (pos - 1).astype("<u4").tobytes() + words.tobytes()


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """Ids of blocks. A wrong checksum is an error."""
    out = []
    for k, block in enumerate(blocks):
        magic, n, vocabulary, lanes, crc, _, steps = HEAD.unpack_from(block)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        ids = _decode(block, vocabulary, lanes, steps)[:n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k}: checksum of the ids is wrong")
        out.append(ids)
    return out


def _decode(block: bytes, vocabulary: int, lanes: int, steps: int) -> np.ndarray:
    sizes = np.frombuffer(block, "<u4", lanes, HEAD.size).astype(np.int64)
    # A lane reads at most its last words beyond its end, where others begin; what it reads there decides nothing.
    words = np.concatenate([np.frombuffer(block, "<u2", offset=HEAD.size + 4 * lanes), np.zeros(8, np.uint16)]).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    code = (words[at] << np.uint64(32)) | (words[at + 1] << np.uint64(16)) | words[at + 2]
    at += 3
    span = np.full(lanes, (1 << 48) - 1, np.uint64)
    model = _Mixture(lanes, steps, vocabulary)
    shift, mask32, top = np.uint64(TOTAL_BITS), np.uint64((1 << 32) - 1), np.uint64(_TOTAL - 1)
    for t in range(steps):
        if _learns(t):
            model.learn(t)
        r = span >> shift
        ids, start, size = model.lookup(t, np.minimum(code // r, top).view(np.int64))
        code -= start.view(np.uint64) * r
        span = size.view(np.uint64) * r
        for _ in range(2):
            m = np.flatnonzero(span <= mask32)
            if not len(m):
                break
            where = at[m]
            code[m] = (code[m] << np.uint64(16)) | words[where]
            at[m] = where + 1
            span[m] <<= np.uint64(16)
        model.past[t + 2] = ids
    return np.ascontiguousarray(model.past[2:].T).reshape(-1)


def pack(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """A run of ids as blocks of nearly equal size."""
    if not len(ids):
        return []
    parts = np.array_split(ids, max(1, -(-len(ids) // BLOCK)))
    return [b for part in parts for b in encode_blocks(part[None], vocabulary)]


def pack_units(which: np.ndarray, sizes: np.ndarray, ids: np.ndarray, vocabulary: int) -> tuple[bytes, list[bytes]]:
    """(the ids of all units, blocks of the sequence of units) of a run of ids, given as numbers of units, ids of each unit, and those
    ids end to end. Without units, blocks are of the ids themselves."""
    if len(sizes) > min(_MOST_VOCABULARY, max(64, len(which) // 2)):
        return b"", pack(joined(which, sizes, ids), vocabulary)
    planes = [np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in (sizes, ids)]
    body = zstandard.compress(b"".join(planes), 3)
    return UNITS.pack(zlib.crc32(body), len(sizes), len(ids)) + body, pack(which, len(sizes))


def unpack_units(units: bytes, blocks: list[bytes]) -> np.ndarray:
    """The run of ids that pack_units was given."""
    symbols = np.concatenate([*decode_blocks(blocks), np.empty(0, np.int64)])
    if not units:
        return symbols.astype("<u4")
    crc, n, total = UNITS.unpack_from(units)
    if zlib.crc32(units[UNITS.size :]) != crc:
        raise ValueError("checksum of the units is wrong")
    raw = np.frombuffer(zstandard.decompress(units[UNITS.size :]), np.uint8)
    sizes, ids = (np.ascontiguousarray(c.reshape(4, -1).T).view("<u4").ravel() for c in (raw[: 4 * n], raw[4 * n : 4 * (n + total)]))
    return joined(symbols, sizes.astype(np.int64), ids)


def joined(which: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ids of a sequence of units."""
    first, each = np.cumsum(sizes) - sizes, sizes[which]
    upto = np.cumsum(each)
    at = np.arange(upto[-1] if len(upto) else 0)
    at += np.repeat(first[which] - (upto - each), each)
    return ids[at]


class UnitEncoder:
    """Texts to ids by units. Texts are cut where a match of the splitting pattern always begins, as before single spaces that
    have other characters on both sides. A batch of texts is cut and its units are told apart in Arrow arrays; _each() encodes
    the units that were not met before, and ids are gathered by unit."""

    #: Tokens that are found in whole texts; no cut goes through one.
    added: list[bytes] = []

    def __init__(self, memory: int):
        #: Units met before, how many ids each has, and those ids end to end.
        self.units, self.sizes, self.ids = pa.array([], pa.large_binary()), np.empty(0, np.int64), np.empty(0, "<u4")
        self.memory = memory

    def _each(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(an order of the units, in that order ids of each, those ids end to end)."""
        raise NotImplementedError

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); null texts are empty. With end_id, it closes
        each text."""
        which, sizes, ids, per_text = self.units_of(texts, end_id)
        total = np.concatenate(([0], np.cumsum(sizes[which])))
        return joined(which, sizes, ids), np.diff(total[np.concatenate(([0], np.cumsum(per_text)))])

    def units_of(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the units of all texts one after another, ids of each distinct unit, those ids end to end, units of each text)."""
        data, ends = bytes_of(texts)
        edge = _borders(data)
        whole = data.tobytes()
        for token in self.added:
            at = whole.find(token)
            while at >= 0:
                edge[at + 1 : at + len(token)] = False
                at = whole.find(token, at + 1)
        edge[ends[:-1][ends[:-1] < len(data)]] = True
        edge[:1] = True
        cuts = np.flatnonzero(edge)
        bounds = np.append(cuts, len(data))
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        coded = units.dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        sizes, table = self._ids(coded.dictionary)
        if end_id is not None:
            # The end is one more unit, put behind the last unit of each text.
            sizes, table = np.append(sizes, 1), np.append(table, np.uint32(end_id))
            last = np.searchsorted(cuts, ends)
            which = np.insert(which, last, len(sizes) - 1)
            per_text = np.diff(np.concatenate(([0], last + np.arange(1, len(ends) + 1))))
        else:
            per_text = np.diff(np.concatenate(([0], np.searchsorted(cuts, ends))))
        return which, sizes, table, per_text

    def _ids(self, units: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each unit, those ids end to end)."""
        at = pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        raw = units.take(pa.array(new))
        order, sizes, ids = self._each(raw.to_numpy(zero_copy_only=False).tolist())
        at[new[order]] = len(self.units) + np.arange(len(new))
        self.units = pa.concat_arrays([self.units, raw.take(pa.array(order))])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        sizes, ids = self.sizes[at], joined(at, self.sizes, self.ids)
        if len(self.units) > self.memory or self.units.nbytes > UNIT_BYTES:
            # Those of this batch stay, which are most of what the next one has.
            self.units, self.sizes, self.ids = units, sizes, ids
        return sizes, ids


class LibraryEncoder(UnitEncoder):
    """Texts to ids by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(UNIT_MEMORY)
        self.library = Tokenizer.from_file(path)
        self.vocabulary_size = self.library.get_vocab_size()
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        (self.line_end,) = self.library.encode("\n", add_special_tokens=False).ids

    def encode(self, text: str | None) -> bytes:
        """Ids of one text, as little-endian unsigned 32-bit integers."""
        return self.encode_column(pa.array([text], pa.string()))[0].tobytes()

    def _each(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(an order of the units, in that order ids of each, those ids end to end). Units that begin with a space and have
        neither other white space nor an added token come first: they are encoded as texts of TEXT units, parted by line ends,
        which are then matches, and ids, of their own."""
        units, whole = [u.decode() for u in raw], b"\n".join(raw)
        added = [a for a in self.added if a in whole]
        together = np.array([len(u.split()) == 1 and u[0] == " " and not u[1:2].isspace() and not u[-1].isspace() for u in units], bool)
        if added:
            together &= np.array([not any(a in r for a in added) for r in raw], bool)
        order = np.argsort(~together, kind="stable")
        n = int(together.sum())
        sizes, parts = [np.empty(0, np.int64)], [np.empty(0, "<u4")]
        for i in range(0, n, TEXT):
            text = "\n".join([units[k] for k in order[i : min(i + TEXT, n)].tolist()])
            flat = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = flat == self.line_end
            sizes.append(np.diff(np.flatnonzero(np.concatenate(([True], ends, [True])))) - 1)
            parts.append(flat[~ends])
        for found in self.library.encode_batch_fast([units[k] for k in order[n:].tolist()], add_special_tokens=False):
            parts.append(np.array(found.ids, "<u4"))
            sizes.append(np.array([len(parts[-1])]))
        return order, np.concatenate(sizes), np.concatenate(parts)


def _borders(data: np.ndarray) -> np.ndarray:
    """Whether a match of the library's splitting pattern always begins at a byte: at a single space that has no
    white space beside it; at a mark or line end behind an ASCII letter; at an ASCII letter behind a single line end.
    Characters whose first bytes white space has too count as white space, which only makes units longer."""
    kind = _KIND[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    for k in range(3):
        at = lead[lead + k < len(data)]
        if k == 2:
            at = at[data[at] != 0xC2]
        kind[at + k] = _WHITE
    edge = np.zeros(len(data), bool)
    before, here = kind[:-1], kind[1:]
    letter = before == _LETTER
    edge[1:] = letter & ((here == _MARK) | (here == _LINE))
    edge[2:] |= (kind[:-2] < _LINE) & (before[1:] == _LINE) & (here[1:] == _LETTER)
    space = np.flatnonzero(data[:-1] == 0x20)
    space = space[space > 0]
    edge[space[(kind[space - 1] < _LINE) & (kind[space + 1] < _LINE)]] = True
    return edge


@lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


_ROW = "shard int, row int, ids array<long>, sizes array<long>, units binary, blocks array<binary>"


def write_token_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, target: str | None = None) -> DataFrame:
    """Write the ids of all documents, in ascending order of their ids, each closed by end_id; returns the
    table as read back: rows of whole documents, numbered by (shard, row). With `target` they are kept there; else they
    are scratch."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = texts.repartitionByRange(shuffle_partitions(docs.sparkSession), "id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, shard, row = library_encoder(path), TaskContext.get().partitionId(), 0
        for part in byte_slices(batches, 1):
            which, sizes, flat, per_text = coder.units_of(part.column(1), end_id)
            total = np.concatenate(([0], np.cumsum(sizes[which])))[np.concatenate(([0], np.cumsum(per_text)))]
            units, blocks = pack_units(which, sizes, flat, coder.vocabulary_size)
            cells = [[shard], [row], [part.column(0).to_pylist()], [np.diff(total)], [units], [blocks]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], ["shard", "row", "ids", "sizes", "units", "blocks"])
            row += 1

    rows = ordered.mapInArrow(with_release(run), _ROW)
    if target is None:
        return materialize(rows, "tokens")
    rows.write.parquet(target)
    return docs.sparkSession.read.schema(_ROW).parquet(target)


def read_token_table(table: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, row, ids, sizes, units, blocks in zip(*(batch.column(k).to_pylist() for k in range(6))):
                flat = unpack_units(units, blocks)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(flat[e - n : e].tobytes()) for e, n in zip(ends, sizes)]
                k = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * k, pa.int32()), pa.array([row] * k, pa.int32()), pa.array(ids, pa.int64()), pa.array(ends - sizes), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["shard", "row", "id", "inside", "n_tokens", "ids_crc32"])

    found = table.select("shard", "row", "ids", "sizes", "units", "blocks").mapInArrow(with_release(run), "shard int, row int, id long, inside long, n_tokens long, ids_crc32 long")
    # One line for each row of about a million ids; sums over shards first, so no window sees them all.
    rows = table.select("shard", "row", F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    shards = rows.groupBy("shard").agg(F.sum("n").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("skip"))
    inside = rows.select("shard", "row", (F.sum("n").over(Window.partitionBy("shard").orderBy("row")) - F.col("n")).alias("local"))
    starts = inside.join(before, "shard").select("shard", "row", (F.col("skip") + F.col("local")).alias("base"))
    return found.join(starts, ["shard", "row"]).select("id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids, read the files back, and return each document's place, length and CRC-32."""
    import public_tokenizers

    table = write_token_table(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_table(table).withColumnRenamed("id", "doc_id")
