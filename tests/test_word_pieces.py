"""Word pieces against trying all pieces, and windows against a plain loop."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.operators import word_pieces as wp


def plain_cut(run, ids):
    """Longest piece first, by trying all lengths."""
    low, out, at = wp.lower(run), [], 0
    while at < len(low) <= wp.LONGEST:
        for end in range(len(low), at, -1):
            piece = (wp.GLUE if at else "") + low[at:end]
            if piece in ids and piece not in wp.SPECIAL:
                out.append((piece, ids[piece], at, end))
                at = end
                break
        else:
            return [("[UNK]", 1, 0, len(low))]
    return out if at == len(low) else [("[UNK]", 1, 0, len(low))]


def plain_encode(text, ids):
    out = []
    for w, word in enumerate(re.finditer(wp.SPACE, text or "")):
        for m in re.finditer(wp.RUN, word[0]):
            out += [(p, k, w, word.start() + m.start() + a, word.start() + m.start() + b) for p, k, a, b in plain_cut(m[0], ids)]
    return out


@pytest.fixture(scope="module")
def ids(spark):
    rng = np.random.default_rng(1)
    made = {"".join(rng.choice(list("abé"), rng.integers(1, 5))) for _ in range(60)}
    rows = [(x,) for x in made | {wp.GLUE + x for x in made} | {"[CLS]", wp.GLUE, "", None, "😀", ".", "b", "##b", "##a"}]
    return wp.vocabulary(spark.createDataFrame(rows, "piece string"))


def test_vocabulary(spark, ids):
    assert [k for k, _ in sorted(ids.items(), key=lambda x: x[1])][:4] == list(wp.SPECIAL)
    rest = [k for k, v in sorted(ids.items(), key=lambda x: x[1])][4:]
    assert rest == sorted(rest) and "" not in ids and None not in ids
    with pytest.raises(RuntimeError):
        wp.vocabulary(spark.createDataFrame([("a",), ("b",), ("a",)], "piece string"), most=1)


def test_greedy_longest_match(ids):
    rng, trie = np.random.default_rng(2), wp.Trie(ids)
    for _ in range(3000):
        run = "".join(rng.choice(list("aAbBéÉ"), rng.integers(1, 14)))
        assert trie.cut(run) == plain_cut(run, ids)
    assert trie.cut("[CLS]") == plain_cut("[CLS]", ids) == [("[UNK]", 1, 0, 5)]
    assert trie.cut("a" * 101) == [("[UNK]", 1, 0, 101)]
    assert wp.Trie(dict(zip(wp.SPECIAL, range(4)))).cut("a") == [("[UNK]", 1, 0, 1)]


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Ab.a  BÉ😀 x İb"), (4, "Ab.a  BÉ😀 x İb"), (5, "ab " * 20000), (6, " a b"), (7, "a" * 300)]


def test_encode(spark, ids):
    table = spark.createDataFrame([(*r, 7, "t") for r in ODD], "id int, text string, pieces int, _given string")
    got = wp.encode(table.drop("_given"), ids, F.col("text"))
    assert got.columns == ["id", "text", "pieces"]
    for r in got.collect():
        assert [tuple(p) for p in r.pieces] == plain_encode(r.text, ids)
        assert all(p.piece == "[UNK]" or wp.lower(r.text[p.start : p.end]) == p.piece.removeprefix(wp.GLUE) for p in r.pieces)
    assert wp.encode(table.limit(0).drop("_given"), ids, F.col("text")).count() == 0
    words = spark.createDataFrame([(1, ["Ab.a", None, "bb"]), (2, None), (3, [])], "id int, w array<string>")
    found = {r.id: [(p.word, p.start, p.end) for p in r.pieces] for r in wp.encode(words, ids, words=F.col("w")).collect()}
    assert found[2] == found[3] == [] and {w for w, *_ in found[1]} == {0, 2} and max(e for _, _, e in found[1]) == 4


def plain_windows(found, tags, content, stride):
    out, at = [], 0
    while found:
        some = found[at : at + content]
        labels, before = [], None
        for _, _, w, _, _ in some:
            t = tags[w]
            labels.append(t if w != before else t + 1 if t > 0 and t % 2 else t)
            before = w
        out.append((at, [2, *(p[1] for p in some), 3], [-100, *labels, -100], [(None, None), *((p[3], p[4]) for p in some), (None, None)]))
        if at + content >= len(found):
            break
        at += content - stride
    return out


@pytest.mark.parametrize("content, stride", [(7, 3), (20, 5), (510, 128)])
def test_windows(spark, ids, content, stride):
    rng = np.random.default_rng(3)
    rows = [(i, ["".join(rng.choice(list("abé."), rng.integers(1, 12))) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 9, 30, 300])]
    rows = [(i, w, [int(x) for x in rng.integers(0, 11, len(w))]) for i, w in rows]
    table = wp.encode(spark.createDataFrame(rows, "id int, w array<string>, t array<int>"), ids, words=F.col("w"))
    for r in table.withColumn("out", wp.windows(F.col("pieces"), F.col("t"), content, stride)).collect():
        got = [(o.start, o.input_ids, o.labels, [tuple(x) for x in o.offsets]) for o in r.out]
        assert got == plain_windows([tuple(p) for p in r.pieces], r.t, content, stride)
