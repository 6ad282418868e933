"""Word pieces by greedy longest match in a trie over a piece vocabulary, with offsets, special ids and windows.

A word is cut into runs of letters and digits and single other characters, each lower-cased and matched from its start: the
longest piece of the vocabulary that fits, then the longest that goes on (written with ## before it), and so on. A run
that cannot be matched to its end, or that is too long, is one unknown piece.

Defined results: null and empty texts have no pieces and no windows; equal texts get equal pieces; an empty vocabulary makes
every run unknown; an empty table gives an empty result; other columns are left as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Letters and digits, and what else is not white space.
RUN = "[0-9A-Za-zÀ-ɏ]+|[^ \\t\\n\\f\\r0-9A-Za-zÀ-ɏ]"
SPACE = "[^ \\t\\n\\f\\r]+"
SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")
GLUE = "##"
LONGEST = 100
#: Bound of the vocabulary, which all tasks get, and of the runs that a worker remembers.
MOST_PIECES, MEMORY = 1 << 20, 300_000
PIECES = "array<struct<piece:string,id:int,word:int,start:int,end:int>>"


def lower(text: str) -> str:
    """Lower case of as many code points."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Trie:
    """Two tries of nested dictionaries: of pieces that begin a run, and of pieces that go on."""

    def __init__(self, ids: dict[str, int]):
        self.ids, self.begin, self.more = ids, {}, {}
        for piece in ids:
            if piece in SPECIAL or piece in ("", GLUE):
                continue
            node, text = (self.more, piece[len(GLUE) :]) if piece.startswith(GLUE) else (self.begin, piece)
            for c in text:
                node = node.setdefault(c, {})
            node[""] = piece
        self.known: dict[str, list[tuple[str, int, int, int]]] = {}

    def cut(self, run: str) -> list[tuple[str, int, int, int]]:
        """(piece, id, start, end) of one run."""
        if run not in self.known:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[run] = self._match(lower(run))
        return self.known[run]

    def _match(self, run: str) -> list[tuple[str, int, int, int]]:
        out, at = [], 0
        while at < len(run) and len(run) <= LONGEST:
            node, found, end = self.more if at else self.begin, None, at
            for i in range(at, len(run)):
                node = node.get(run[i])
                if node is None:
                    break
                if "" in node:
                    found, end = node[""], i + 1
            if found is None:
                break
            out.append((found, self.ids[found], at, end))
            at = end
        return out if at == len(run) else [(SPECIAL[1], SPECIAL.index(SPECIAL[1]), 0, len(run))]


def vocabulary(pieces: DataFrame, most: int = MOST_PIECES) -> dict[str, int]:
    """Column `piece` -> ids: the special pieces first, then the others in order. RuntimeError: more than `most` pieces."""
    rows = pieces.select(F.col("piece")).where("piece is not null and piece != ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise RuntimeError(f"more than {most} pieces: a vocabulary is sent to all tasks")
    return {p: i for i, p in enumerate([*SPECIAL, *sorted({r.piece for r in rows} - set(SPECIAL))])}


def encode(rows: DataFrame, ids: dict[str, int], text: Column | None = None, words: Column | None = None, out: str = "pieces") -> DataFrame:
    """rows with the column `out`: (piece, id, word, start, end) of a text, or of a list of words. word is the number of
    the word, of a text the white-space one; offsets are code points, in the text or in the word."""
    shared, whole = rows.sparkSession.sparkContext.broadcast(ids), words is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        runs, spaced = re.compile(RUN), re.compile(SPACE)
        for batch in batches:
            # Column by column: a dictionary for each piece would cost more than the matching.
            ends, names, numbers, places, starts, stops = [0], [], [], [], [], []
            for given in batch.column(batch.num_columns - 1).to_pylist():
                parts = [(m.start(), m[0]) for m in spaced.finditer(given or "")] if whole else [(0, w or "") for w in given or []]
                for w, (shift, word) in enumerate(parts):
                    for m in runs.finditer(word):
                        at = shift + m.start()
                        for p, k, a, b in trie.cut(m[0]):
                            names.append(p)
                            numbers.append(k)
                            places.append(w)
                            starts.append(at + a)
                            stops.append(at + b)
                ends.append(len(names))
            cells = pa.StructArray.from_arrays([pa.array(names, pa.string()), *(pa.array(x, pa.int32()) for x in (numbers, places, starts, stops))], ["piece", "id", "word", "start", "end"])
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], out])

    given = words if words is not None else F.coalesce(text.cast("string"), F.lit(""))
    kept = rows.withColumn("_given", given).drop(out).withColumnRenamed("_given", out)
    fields = T.fields(kept.drop(out))
    return kept.mapInArrow(run, f"{fields}, `{out}` {PIECES}" if fields else f"`{out}` {PIECES}")


def windows(pieces: Column, tags: Column, content: int = 510, stride: int = 128) -> Column:
    """Windows of (start, input_ids, labels, offsets) between the special ids, overlapping by `stride`. The first piece of a
    word, and of a window, has the word's label; others go on with it, a B as I; specials have -100 and no offsets."""
    follows = lambda t: F.when((t > 0) & (t % 2 == 1), t + 1).otherwise(t)
    cls, sep = SPECIAL.index("[CLS]"), SPECIAL.index("[SEP]")
    step = content - stride

    def window(all_p: Column, start: Column) -> Column:
        some = F.slice(all_p, start + 1, F.lit(content))

        def label(p: Column, i: Column) -> Column:
            first = (i == 0) | (F.get(all_p, start + i - 1)["word"] != p["word"])
            return T.let(F.get(tags, p["word"]), lambda t: F.when(first, t).otherwise(follows(t)))

        around = lambda left, inner, right: F.concat(F.array(left), inner, F.array(right))
        none = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
        return F.struct(
            start.alias("start"), around(F.lit(cls), F.transform(some, lambda p: p["id"]), F.lit(sep)).alias("input_ids"),
            around(F.lit(-100), F.transform(some, label), F.lit(-100)).alias("labels"),
            around(none, F.transform(some, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))), none).alias("offsets"),
        )

    def cut(all_p: Column) -> Column:
        n = F.size(all_p)
        starts = F.when(n == 0, F.array().cast("array<int>")).when(n <= content, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - stride - 1, F.lit(0)), F.lit(step)))
        return F.transform(starts, lambda s: window(all_p, s))

    return T.let(pieces, cut)
