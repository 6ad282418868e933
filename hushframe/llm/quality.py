"""Quality rules over repeated passages inside a text, found with suffix arrays.

The words of many documents are laid end to end, each document with symbols of its own, so that one
vectorised prefix-doubling sort yields every document's suffix array and no repeat can cross a border.
Longest-common-prefix values come from the ranks kept at each doubling. A position's longest repeat is the
larger of its two neighbouring LCP values; the union of those spans is the union of the maximal repeats'
spans. A text is rejected when such repeats cover too large a share of it or one of them is too long.

Defined results: null and empty texts have no words and fail the base rule; repeated rows get equal
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, documents, with_release

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
#: Bytes of text that share one suffix array; a longer text has one of its own.
_SLICE = 2 << 20


@dataclass(frozen=True)
class RepetitionLimits:
    """min_words: shortest repeat that counts (longer than one repeated licence line); max_covered: largest
    share of words inside such repeats; max_longest: longest repeat in words."""

    min_words: int = 20
    max_covered: float = 0.2
    max_longest: int = 100


def suffix_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols; the last entry ranks them fully.

    Each round sorts only suffixes that still tie, by the rank of what follows."""
    n = len(symbols)
    if not n:
        return [np.empty(0, np.int64)]
    counts = np.bincount(symbols)
    below = np.concatenate(([0], np.cumsum(counts)[:-1]))
    rank = below[symbols]
    levels, step = [rank], 1
    active = np.flatnonzero(counts[symbols] > 1)
    while len(active):
        at = active + step
        follow = np.where(at < n, rank[np.minimum(at, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        key, group = key[order], rank[active][order]
        lead_group, lead = np.ones(len(order), bool), np.ones(len(order), bool)
        lead_group[1:] = group[1:] != group[:-1]
        lead[1:] = key[1:] != key[:-1]
        here = np.arange(len(order))
        first_group = np.maximum.accumulate(np.where(lead_group, here, 0))
        first = np.maximum.accumulate(np.where(lead, here, 0))
        rank = rank.copy()
        rank[active[order]] = group + first - first_group
        levels.append(rank)
        size = np.diff(np.append(np.flatnonzero(lead), len(order)))
        active = np.sort(active[order][np.repeat(size > 1, size)])
        step *= 2
    return levels


def neighbour_lcp(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lcp) where lcp[i] is what suffixes i-1 and i share; lcp[0] is 0."""
    rank = levels[-1]
    n = len(rank)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    if n > 1:
        pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
        a, b, shared = order[pair - 1], order[pair], np.zeros(len(pair), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + shared, b + shared
            inside = np.maximum(x, y) < n
            same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
            shared += same.astype(np.int64) << k
        lcp[pair] = shared
    return order, lcp


def longest_at(levels: list[np.ndarray]) -> np.ndarray:
    """For each position, the length of the longest substring that starts there and occurs elsewhere too: that of the
    deepest LCP interval which holds the suffix, the greater of the suffix's two LCP values. The spans of these
    intervals have the same union, and the same longest, as those of all maximal repeats, of which a repetitive text
    has so many occurrences that listing them all would take the square of its length."""
    order, lcp = neighbour_lcp(levels)
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(lcp, np.append(lcp[1:], 0)) if len(order) else lcp
    return out


def maximal_repeats(symbols: np.ndarray, min_length: int) -> list[tuple[int, list[int]]]:
    """(length, starts) of every maximal repeated substring of one sequence: the LCP intervals, left out
    where every occurrence is preceded by the same symbol."""
    order, lcp = neighbour_lcp(suffix_ranks(symbols))
    found, stack = [], [(0, 0)]

    def close(length: int, lo: int, hi: int) -> None:
        starts = np.sort(order[lo : hi + 1])
        before = {int(symbols[s - 1]) if s else -1 for s in starts}
        if length >= min_length and (len(before) > 1 or -1 in before):
            found.append((length, starts.tolist()))

    for i in range(1, len(order) + 1):
        now, lo = (int(lcp[i]) if i < len(order) else 0), i - 1
        while stack[-1][0] > now:
            length, lo = stack.pop()
            close(length, lo, i - 1)
        if stack[-1][0] < now:
            stack.append((now, lo))
    return found


def covered(longest: np.ndarray, min_length: int) -> np.ndarray:
    """Positions inside the union of repeats of at least min_length symbols."""
    n = len(longest)
    start = np.flatnonzero(longest >= min_length)
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + longest[start], minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def base_counts(text: str | None) -> tuple[list[bytes], tuple[int, int, int, int]]:
    """(words, (n_words, word_chars, n_symbols, n_dup_lines)) of a text."""
    s = text or ""
    raw = s.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(s) - len(raw) + len(raw.translate(None, _SPACE))
    return words, (len(words), chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)))


def measure_texts(texts: Iterable[str | None], min_words: int) -> np.ndarray:
    """(texts, 7) numbers in the order of _FIELDS, from one suffix array over all the texts."""
    base, symbols, counts, offset = [], [], [], 0
    for text in texts:
        words, cells = base_counts(text)
        base.append(cells)
        seen: dict[bytes, int] = {}
        give = seen.setdefault
        symbols.append(np.fromiter((give(w, len(seen)) for w in words), np.int64, len(words)) + offset)
        offset += len(seen)
        counts.append(len(words))
    n = np.array(counts, np.int64)
    cells = np.zeros((len(n), 3), np.int64)
    full = np.flatnonzero(n)
    if len(full):
        longest = longest_at(suffix_ranks(np.concatenate(symbols)))
        cut = np.concatenate(([0], np.cumsum(n[full])[:-1]))
        cells[full, 0] = np.add.reduceat(covered(longest, 3).astype(np.int64), cut)
        cells[full, 1] = np.add.reduceat(covered(longest, min_words).astype(np.int64), cut)
        cells[full, 2] = np.maximum.reduceat(longest, cut)
    return np.column_stack([np.array(base, np.int64).reshape(-1, 4), cells])


def measures(docs: DataFrame, id_col: str, text_col: str, limits: RepetitionLimits) -> DataFrame:
    """id and the counts of _FIELDS for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", _SLICE):
            table = measure_texts((t.as_py() for t in part.column(1)), limits.min_words)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(table[:, k]) for k in range(7))], ["id", *_FIELDS])

    schema = "id long, " + ", ".join(f"{x} long" for x in _FIELDS)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", limits: RepetitionLimits = RepetitionLimits()) -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, at, _SLICE):
            n = dict(zip(_FIELDS, measure_texts((t.as_py() for t in part.column(at)), limits.min_words).T))
            failed = (n["n_words"] < 50) | (100 * n["n_repeat_words"] > 50 * n["n_words"])
            repetitive = (n["covered_words"] > limits.max_covered * n["n_words"]) | (n["longest_repeat"] > limits.max_longest)
            yield part.filter(pa.array(~failed & ~repetitive))

    return docs.mapInArrow(with_release(run), docs.schema)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: RepetitionLimits = RepetitionLimits()) -> DataFrame:
    """Counts and the verdict: base_failed, and kept = neither the base rule nor the repetition limits fail."""
    m = measures(docs, id_col, text_col, limits)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    repetitive = (F.col("covered_words") > limits.max_covered * F.col("n_words")) | (F.col("longest_repeat") > limits.max_longest)
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repetitive)


def op2_quality_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, repetition measures and verdict."""
    found = quality_rules(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")
