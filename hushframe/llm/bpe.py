"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A byte string has exactly one BPE encoding, and so has each of its prefixes. The table of a string keeps,
for every prefix, the last token of that prefix's encoding. The last token of a prefix is the one token
that ends there, encodes to itself, and forms a valid pair with the last token of the shorter prefix it
follows: two tokens are a valid pair if their joined bytes encode to just those two. The encoding is read
off backwards. Appending bytes extends the table exactly; an edit recomputes it from the edit on and stops
as soon as the new entries run along the old ones. The tables of many short pieces grow together, a byte of
each at a time, as array operations.

A piece that is itself in the vocabulary is one token, as rank-file encoders have it, even where the merges
alone would not reach that token.

Defined results: null texts encode as empty; empty texts give no ids; repeated rows get equal ids; an empty
table gives an empty result; lone surrogates are replaced as UTF-8 encoders do; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, documents, with_release
from .token_files import UnitEncoder

#: Bounds of a worker's memory of units and of token pairs; results do not depend on them.
UNIT_MEMORY = 500_000
PAIR_MEMORY = 500_000
#: Bits of a place in the memory of pairs that arrays of them have.
PAIR_BITS = 21
#: Bytes of pieces whose tables grow together, of the longest of them, and of texts that are encoded together.
TOGETHER, SHORT, SLICE = 64 << 10, 128, 2 << 20
#: The rank of a merge that never happens.
NEVER = 1 << 60
#: What parts the pieces of a search; no byte stands as it.
_BETWEEN = "\u0100"


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: join the adjacent parts of least rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Vocabulary:
    """Ranks of a tiktoken file, with the tests that the prefix tables need."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        #: Finds all tokens that end at each byte in one pass; bytes stand as the code points 0 to 255.
        self.ending = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.ending.add_word(token.decode("latin-1"), rank)
        self.ending.make_automaton()
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.longest = max(map(len, ranks), default=0)
        self.histories: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        #: Pairs with their verdict in the lowest bit, each at the place that its hash gives; a newer one takes an older one's.
        self.verdicts = np.full(1 << PAIR_BITS, -1, np.int64)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def history(self, token: int) -> tuple | None:
        """The merges that build a token from its bytes, in order: (rank, first part, last part) before each
        of them and, with an infinite rank, at the end; None if merging its bytes gives other tokens."""
        if token in self.histories:
            return self.histories[token]
        piece, ranks = self.tokens[token], self.ranks
        parts, steps = [piece[i : i + 1] for i in range(len(piece))], []
        while len(parts) > 1:
            joined = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = min(joined)
            if best == NEVER:
                break
            steps.append((best, parts[0], parts[-1]))
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        steps.append((NEVER, parts[0], parts[-1]))
        found = self.histories[token] = tuple(steps) if len(parts) == 1 else None
        return found

    def valid_pair(self, left: int, right: int) -> bool:
        """Whether the two tokens' joined bytes encode to just them. Both sides merge on their own, least
        rank first, until a merge across the border outranks their next ones; on equal ranks the leftmost
        goes first."""
        a, b = self.history(left), self.history(right)
        if a is None or b is None:
            return False
        i = j = 0
        get = self.ranks.get
        while True:
            (ra, _, x), (rb, y, _) = a[i], b[j]
            across = get(x + y, NEVER)
            if across < ra and across <= rb and across != NEVER:
                return False
            if ra <= rb:
                if ra == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def extend(self, piece: bytes, last: list[int]) -> None:
        """Add the last tokens of the prefixes of piece that are longer than len(last)."""
        begin = len(last)
        base = max(0, begin + 1 - self.longest)
        pairs, need = self.pairs, begin
        for end, token in self.ending.iter(piece[base:].decode("latin-1")):
            end += base
            if end == need:
                start = end + 1 - len(self.tokens[token])
                if start:
                    key = last[start - 1] << 32 | token
                    valid = pairs.get(key)
                    if valid is None:
                        if len(pairs) >= PAIR_MEMORY:
                            pairs.clear()
                        valid = pairs[key] = self.valid_pair(last[start - 1], token)
                else:
                    valid = self.history(token) is not None
                if valid:
                    last.append(token)
                    need += 1
        if need != len(piece):
            raise ValueError(f"no token ends at byte {need} of {piece!r}")

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else PrefixTable(self, piece).ids()

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, those ids end to end)."""
        get = self.ranks.get
        ranks = np.array([get(p, -1) for p in pieces], np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sizes = (ranks >= 0).astype(np.int64)
        whole, short = np.flatnonzero(ranks >= 0), np.flatnonzero((ranks < 0) & (lengths > 0) & (lengths <= SHORT))
        found = [(whole, ranks[whole])]
        for some in np.split(short, np.flatnonzero(np.diff(np.cumsum(lengths[short]) // TOGETHER)) + 1) if len(short) else []:
            sizes[some], ids = self._together([pieces[k] for k in some.tolist()])
            found.append((some, ids))
        for k in np.flatnonzero((ranks < 0) & (lengths > SHORT)).tolist():
            ids = np.array(self.encode_piece(pieces[k]), np.int64)
            sizes[k] = len(ids)
            found.append((np.array([k]), ids))
        first = np.cumsum(sizes) - sizes
        out = np.empty(sizes.sum(), "<u4")
        for some, ids in found:
            each = sizes[some]
            out[np.repeat(first[some] - (np.cumsum(each) - each), each) + np.arange(len(ids))] = ids
        return sizes, out

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """encode_pieces() of pieces that are no tokens, by their prefix tables, all of them a byte longer at each step."""
        none = len(self.tokens)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(lengths + 1) - (lengths + 1)
        text = _BETWEEN.join([p.decode("latin-1") for p in pieces])
        flat = np.fromiter(chain.from_iterable(self.ending.iter(text)), np.int64)
        end, token = flat[::2], flat[1::2]
        step = end - np.repeat(begins, lengths + 1)[end]
        order = np.argsort(step.astype(np.int16), kind="stable")
        end, token = end[order], token[order]
        before = end - self.sizes[token]
        bounds = np.cumsum(np.bincount(step, minlength=lengths.max())).tolist()
        # What stands before a piece, and behind the last one, stays without a token.
        last = np.full(len(text) + 1, none, np.int64)
        for a, b in zip([0, *bounds], bounds):
            valid = self._valid(last[before[a:b]] << 32 | token[a:b])
            last[end[a:b][valid]] = token[a:b][valid]
        lost = last == none
        lost[begins - 1] = False
        if lost.any():
            at = int(lost.argmax())
            k = int(np.searchsorted(begins, at, "right")) - 1
            raise ValueError(f"no token ends at byte {at - begins[k]} of {pieces[k]!r}")
        which, at, back = np.arange(len(pieces)), begins + lengths - 1, []
        while len(which):
            back.append((which, last[at]))
            at = at - self.sizes[back[-1][1]]
            more = at >= begins[which]
            which, at = which[more], at[more]
        sizes = np.bincount(np.concatenate([w for w, _ in back]), minlength=len(pieces))
        out, upto = np.empty(sizes.sum(), np.int64), np.cumsum(sizes)
        for k, (which, ids) in enumerate(back):
            out[upto[which] - 1 - k] = ids
        return sizes, out

    def _valid(self, keys: np.ndarray) -> np.ndarray:
        """valid_pair() of each key, whose upper half is the left token; len(tokens) is none, and then the right one has to
        encode to itself."""
        at = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        known = self.verdicts[at]
        new = np.flatnonzero(known >> 1 != keys)
        if len(new):
            fresh, where = np.unique(keys[new], return_inverse=True)
            none, low = len(self.tokens), (1 << 32) - 1
            said = np.array([self.valid_pair(k >> 32, k & low) if k >> 32 != none else self.history(k & low) is not None for k in fresh.tolist()], bool)
            known[new] = keys[new] << 1 | said[where]
            self.verdicts[at[new]] = known[new]
        return (known & 1).astype(bool)


class PrefixTable:
    """The last tokens of all prefixes of one piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Exact: earlier entries stay as they are."""
        self.piece += more
        self.vocabulary.extend(self.piece, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put `new` for piece[start:end]; returns how many entries were computed anew. Entries before the
        edit are kept; those after it are kept once a whole longest-token window of them, ending at the same
        distance from the end, came out as before."""
        old_last, tail = self.last[end:], len(self.piece) - end
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = self.last[:start]
        window, done, alike = self.vocabulary.longest, 0, 0
        first_old = len(self.piece) - tail
        while len(self.last) < len(self.piece):
            at = len(self.last)
            self.vocabulary.extend(self.piece[: at + window], self.last)
            done += len(self.last) - at
            for k in range(max(at, first_old), len(self.last)):
                alike = alike + 1 if self.last[k] == old_last[k - first_old] else 0
                if alike >= window:
                    self.last[k + 1 :] = old_last[k + 1 - first_old :]
                    return done
        return done

    def tokens(self) -> list[int]:
        out, end, texts = [], len(self.piece), self.vocabulary.tokens
        while end:
            out.append(self.last[end - 1])
            end -= len(texts[out[-1]])
        return out[::-1]

    def ids(self) -> list[int]:
        rank = self.vocabulary.ranks.get(self.piece)
        return [rank] if rank is not None else self.tokens()


#: Letters after a space, in ASCII, are one match; so they need no pattern.
_WORD = re.compile(rb" ?[A-Za-z]+")


class TextEncoder(UnitEncoder):
    """Whole texts to ids as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__(UNIT_MEMORY)
        self.vocabulary = vocabulary
        self.split = regex.compile(pattern)
        self.starts = np.concatenate(([0], np.cumsum(vocabulary.sizes)[:-1]))
        self.blob = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)

    def _each(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(an order of the units, in that order ids of each, those ids end to end). Units that are one match come first."""
        word = _WORD.fullmatch
        one = np.array([word(u) is not None for u in raw], bool)
        order = np.argsort(~one, kind="stable")
        n = int(one.sum())
        matches = [self.split.findall(raw[k].decode()) for k in order[n:].tolist()]
        pieces = [raw[k] for k in order[:n].tolist()] + [p.encode() for p in chain.from_iterable(matches)]
        sizes, ids = self.vocabulary.encode_pieces(pieces)
        upto = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.cumsum([0] + [1] * n + [len(m) for m in matches])
        return order, np.diff(upto[ends]), ids

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text.encode("utf-8", "replace")], pa.binary()))[0].tobytes()

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids, gathered from one table of all tokens' bytes, a bounded part at a time."""
        all_ids, out = np.frombuffer(ids, "<u4").astype(np.int64), []
        for i in range(0, len(all_ids), 1 << 18):
            part = all_ids[i : i + (1 << 18)]
            sizes = self.vocabulary.sizes[part]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(self.starts[part] - (ends - sizes), sizes)
            out.append(self.blob[at].tobytes())
        return b"".join(out)

    def both_ways(self, texts: pa.Array) -> Iterator[tuple[memoryview, memoryview]]:
        """(ids, bytes decoded from them) of each text; null texts are empty."""
        ids, sizes = self.encode_column(texts)
        raw = ids.astype("<u4", copy=False).tobytes()
        decoded = memoryview(self.decode(raw))
        ends, upto = np.cumsum(sizes), np.concatenate(([0], np.cumsum(self.vocabulary.sizes[ids])))
        bounds, where = [0, *(4 * ends).tolist()], [0, *upto[ends].tolist()]
        raw = memoryview(raw)
        for a, b, c, d in zip(bounds, bounds[1:], where, where[1:]):
            yield raw[a:b], decoded[c:d]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder in each Python worker."""
    return TextEncoder(Vocabulary.load(path), pattern)


def tokenize(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded binary) for every row: ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for part in byte_slices(batches, "text", SLICE):
            ids, decoded = zip(*((x.tobytes(), y.tobytes()) for x, y in coder.both_ways(part.column(1))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, ids binary, decoded binary")


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """tokenize(), with only the number of ids and the SHA-256 of ids and decoded bytes sent back to the JVM;
    with_ids: the ids too. extra: columns to carry along."""
    names = {c: f"extra_{k}" for k, c in enumerate(extra)}
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(n) for c, n in names.items()))
    fields = "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for part in byte_slices(batches, "text", SLICE):
            counts, a, b, c = [], [], [], []
            for ids, decoded in coder.both_ways(part.column(1)):
                counts.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    c.append(ids.tobytes())
            cols = [part.column(0), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *(part.column(k) for k in range(2, part.num_columns))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(c, pa.binary())] * with_ids, ["id", "n_tokens", "ids_sha256", "decoded_sha256", *names.values()] + ["ids"] * with_ids)

    out = kept.mapInArrow(with_release(run), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + fields + ", ids binary" * with_ids)
    return out.withColumnsRenamed({n: c for c, n in names.items()})


def production_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of the bytes decoded from them."""
    return token_digests(documents(spark, sf_dir), *production_vocabulary()).withColumnRenamed("id", "doc_id")
