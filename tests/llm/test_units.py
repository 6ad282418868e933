"""The methods themselves, without Spark, against brute force."""

import random
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from hushframe.llm import bpe, language_id, ngram_lm, ordinal, quality, simhash, token_files
from hushframe.llm import product_quantisation as pq
from hushframe.llm.eliasfano import EliasFano, SortedLists, lists_build

PIECES = ["a", "b", "th", "e", " ", "  ", "\n", " \n", "\t", "1", "23", "é", "日本", "😀", "'s", "'ll", "!", "...", "　", "\xa0", "ß", "x" * 50, "-" * 30, "\x00", "ab" * 40, "<|endoftext|>"]


def texts(n, seed=3, size=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_equals_library_and_decodes(vocabulary):
    ours = bpe.TextEncoder(vocabulary, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    for t in [*texts(2000), "word " * 5000, "x" * 5000]:
        ids = ours.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t)
        assert ours.decode(ids) == t.encode()


def test_bpe_tables_grow_together(monkeypatch):
    """New pieces are encoded as arrays, not one by one; small memories and few bytes at a time change no ids."""
    monkeypatch.setattr(bpe, "PAIR_BITS", 6)
    monkeypatch.setattr(bpe, "TOGETHER", 300)
    monkeypatch.setattr(bpe, "UNIT_MEMORY", 50)
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(8)
    pieces = ["".join(rng.choice("thein aéßж中=") for _ in range(rng.choice((0, 1, 2, 5, 9, 30)))).encode() for _ in range(600)]
    long = b"th" * bpe.SHORT
    sizes, ids = vocabulary.encode_pieces([*pieces, long])
    want = [[vocabulary.ranks[p]] if p in vocabulary.ranks else [vocabulary.ranks[t] for t in bpe.merge_bytes(p, vocabulary.ranks)] for p in [*pieces, long]]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert [a.tolist() for a in vocabulary.encode_pieces([])] == [[], []]

    def one_by_one(*_):
        raise AssertionError("a short piece was encoded on its own")

    monkeypatch.setattr(bpe.Vocabulary, "extend", one_by_one)
    ours = bpe.TextEncoder(vocabulary, public_tokenizers.PATTERN)
    for seed in range(4):
        some = [*(t for t in texts(150, seed=seed) if all(len(w) < 30 for w in t.split())), "it's\n x\x85 y\u3000z  a", "", "\n", None]
        for t, (ids, decoded) in zip(some, ours.both_ways(pa.array(some, pa.string())), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t or "")
            assert bytes(decoded) == (t or "").encode()

    without = bpe.Vocabulary({bytes([k]): k for k in range(255)})
    with pytest.raises(ValueError, match="byte 1 of"):
        without.encode_pieces([b"ab", b"a\xffb"])


def test_prefix_tables_append_and_edit(vocabulary):
    rng = random.Random(5)
    for _ in range(150):
        table = bpe.PrefixTable(vocabulary, bytes(rng.choice(b"abcdefghthe ing") for _ in range(rng.randint(0, 200))))
        for _ in range(4):
            a = rng.randint(0, len(table.piece))
            table.replace(a, min(len(table.piece), a + rng.randint(0, 4)), bytes(rng.choice(b"abcdthe") for _ in range(rng.randint(0, 4))))
            table.append(b"in"[: rng.randint(0, 2)])
            assert table.last == bpe.PrefixTable(vocabulary, table.piece).last
    long = bpe.PrefixTable(vocabulary, b"abcdefgh" * 500)
    assert long.replace(2000, 2001, b"z") < 500


def test_elias_fano_search():
    rng = np.random.default_rng(0)
    for t in range(120):
        n, top = int(rng.integers(0, 300)), [5, 100, 10**6, 2**63][t % 4]
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = EliasFano(EliasFano.build(v, ""), "")
        assert (e.at(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, top, 30, dtype=np.uint64), np.array([0, top], np.uint64)])
        assert (e.successor(q) == np.searchsorted(v, q)).all()
        lists = [np.unique(rng.integers(0, [6, 1000][t % 2], int(rng.integers(1, 30)))) for _ in range(int(rng.integers(1, 20)))]
        s = SortedLists(lists_build(np.array([len(x) for x in lists]), np.concatenate(lists), ""), "")
        k, x = rng.integers(0, len(lists), 100), rng.integers(0, 1200, 100)
        start = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        got, lo = s.find(k, x.astype(np.uint64))
        for a, b, g, low in zip(k, x, got, lo):
            at = np.flatnonzero(lists[a] == b)
            assert g == (start[a] + at[0] if len(at) else -1) and low == start[a]


def test_suffix_arrays_and_repeats():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(0, 50))
        s = rng.integers(0, rng.integers(1, 6) + 1, n)
        levels = quality.suffix_ranks(s)
        order, lcp = quality.neighbour_lcp(levels)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        longest = quality.longest_at(levels)
        share = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or s[i + k] != s[j + k]), 0)
        assert all(longest[i] == max((share(i, j) for j in range(n) if j != i), default=0) for i in range(n))
        inside = np.zeros(n, bool)
        for size, starts in quality.maximal_repeats(s, 3):
            for a in starts:
                inside[a : a + size] = True
        assert (inside == quality.covered(longest, 3)).all()


def test_repeats_do_not_cross_texts():
    one = " ".join(f"w{i}" for i in range(100))
    m = quality.measure_texts([one, one, None, "", one + " " + one], 20)
    assert m[:, 0].tolist() == [100, 100, 0, 0, 200] and m[:, 4].tolist() == [0, 0, 0, 0, 200] and m[:, 6].tolist() == [0, 0, 0, 0, 100]


def test_bk_forest_links_like_all_pairs():
    rng = np.random.default_rng(2)
    for t in range(60):
        n = int(rng.integers(1, 120))
        words = rng.integers(0, 2**64, (n, 1), dtype=np.uint64)
        for i in range(1, n):
            if rng.random() < 0.6:
                words[i] = words[rng.integers(0, i)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 6), dtype=np.uint64))
        roots = np.zeros(n, np.int64)
        roots[n // 2 :] = n // 2
        got = simhash.link_groups(words, roots, 3)
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(n):
            for j in range(i):
                if roots[i] == roots[j] and (words[i] ^ words[j])[0].bit_count() <= 3:
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
        assert got.tolist() == [find(i) for i in range(n)]


def test_confirmed_finds_by_trees_of_fingerprints(monkeypatch):
    """All links at similarity 0.8 of each cell, and every pair that is decided comes from a BK-tree of fingerprints."""
    rng = np.random.default_rng(12)
    built, found = [], []

    class Forest(simhash.BKForest):
        def __init__(self, words, roots):
            built.append(words)
            super().__init__(words, roots)
            found.extend(len(a) for a, _, _ in self.met)

    monkeypatch.setattr(simhash, "BKForest", Forest)
    for t in range(40):
        sets = []
        while len(sets) < 60:
            m = int(rng.integers(1, 40))
            x = int(rng.integers(0, m + 1))
            shared, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (4 * m, x, m - x))
            sets += [np.unique(np.concatenate((shared, a))), np.unique(np.concatenate((shared, b)))]
            if rng.random() < 0.5:  # just below 0.8
                sets.append(np.unique(np.concatenate((shared, a, rng.integers(0, 2**64, m - x + 1, dtype=np.uint64)))))
        sets = [*(sets[i] for i in rng.permutation(len(sets))), np.empty(0, np.uint64), np.empty(0, np.uint64)]
        n = len(sets)
        roots = np.zeros(n, np.int64)
        roots[n // 3 :] = n // 3
        known = rng.integers(0, 3, n) if t % 2 else np.arange(n)
        want = np.arange(n)
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if roots[i] == roots[j] and (known[i] == known[j] or 5 * both >= 4 * max(len(sets[i]) + len(sets[j]) - both, 1)):
                    a, b = sorted((want[i], want[j]))
                    want[want == b] = a
        assert simhash.confirmed(sets, roots, known).tolist() == want.tolist()
    assert len(built) == 40 and all(w.shape[1] == simhash.WIDE for w in built) and sum(found)


def test_workers_give_freed_memory_back():
    """A stage's freed memory does not stay with the worker, which the next stages use too."""
    from hushframe.llm.common import with_release

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon")) // 1024

    def run(batches):
        kept = []
        for batch in batches:
            rows = [bytes([65]) * 400 for _ in range(500_000)]
            kept.append(rows[-1])  # what stays holds the top of the heap
            del rows
            yield batch

    before = held()
    assert list(with_release(run)(iter([1, 2]))) == [1, 2]
    assert held() - before < 100


def test_elias_fano_looks_up_in_pieces(monkeypatch):
    """Neighbours together, the select in a word, and lookups of more numbers than a piece, against plain arrays."""
    from hushframe.llm import eliasfano

    rng = np.random.default_rng(8)
    word = np.concatenate((rng.integers(0, 2**64, 3000, dtype=np.uint64), rng.integers(0, 2**64, 3000, dtype=np.uint64) & rng.integers(0, 2**64, 3000, dtype=np.uint64) & rng.integers(0, 2**64, 3000, dtype=np.uint64), np.array([1, 1 << 63, 2**64 - 1], np.uint64)))
    word = word[word > 0]
    k = (rng.random(len(word)) * np.bitwise_count(word)).astype(np.int64)
    want = [[i for i in range(64) if int(w) >> i & 1][j] for w, j in zip(word, k)]
    assert eliasfano._select_in_word(word, k).tolist() == want
    for piece in (1 << 14, 7):
        monkeypatch.setattr(eliasfano, "PIECE", piece)
        for top in (3, 500, 2**40, 2**64):
            v = np.sort(rng.integers(0, top, 2000, dtype=np.uint64))
            e = EliasFano(EliasFano.build(v, ""), "")
            i = rng.integers(0, len(v) - 1, 500)
            a, b = e.both(i)
            assert (a == v[i]).all() and (b == v[i + 1]).all() and (e.at(np.arange(len(v))) == v).all()
            x = np.concatenate((v, rng.integers(0, top, 2000, dtype=np.uint64)))
            at = np.searchsorted(v, x)
            hit = v[np.minimum(at, len(v) - 1)] == x
            assert (e.find(x) == np.where(hit, at, -1)).all()
            lo = rng.integers(0, len(v), len(x))
            hi = np.minimum(lo + rng.integers(0, 400, len(x)), len(v))
            inside = np.clip(at, lo, hi)
            hit = (inside < hi) & (v[np.minimum(inside, len(v) - 1)] == x)
            assert (e.find(x, lo, hi) == np.where(hit, inside, -1)).all()


def test_majority_bits():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 2, 700, 255, 256])
    h = rng.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    got = simhash.majority_bits(h, counts, 1)
    at = 0
    for k, n in enumerate(counts):
        part = h[at : at + n]
        at += n
        want = sum(1 << b for b in range(64) if 2 * int(((part >> np.uint64(b)) & np.uint64(1)).sum()) > n)
        assert int.from_bytes(got[k].tobytes(), "big") == want


def test_quantiser_error_bounds():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = pq.Quantiser(x, 8)
    cell, codes, error, away = q.encode(x)
    assert np.allclose(np.linalg.norm(x - q.coarse[cell] - q.decode(codes), axis=1), error)
    tables = q.tables(x[:5] - q.coarse[0])
    direct = pq.distances(x[:5] - q.coarse[0], q.decode(codes))
    assert np.allclose(sum(t[:, codes[:, k]] for k, t in enumerate(tables)), direct)


def test_words_are_hashed_without_python_calls():
    """Distinct words are hashed by one mapped call, so the interpreter's share does not grow with them."""
    calls = []
    column = pa.array([" ".join(f"Word{i}" for i in range(3000)), None])
    ngram_lm.tokens_of(column)
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        hashes, which, counts = ngram_lm.tokens_of(column)
    finally:
        sys.setprofile(None)
    assert len(calls) < 300 and counts.tolist() == [3001, 1]
    assert hashes[which].tolist() == [*(xxhash.xxh64_intdigest(f"word{i}".encode()) for i in range(3000)), ngram_lm.END, ngram_lm.END]


def test_runs_of_equal_high_bits_over_words():
    """Runs longer than a word, empty sequences and numbers beyond the last are found as a search of the numbers finds them."""
    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1), (90, 5), (300, 2**40), (200, 2**63 - 1)):
        values = np.sort(np.concatenate([rng.integers(0, top, n).astype(np.uint64), np.full(200 * (n > 1), top // 2, np.uint64)]))
        ef = EliasFano(EliasFano.build(values, "x_"), "x_")
        sought = np.concatenate([values, rng.integers(0, top, 50).astype(np.uint64), np.array([0, 1, 2**63, 2**64 - 1], np.uint64)])
        place = np.searchsorted(values, sought)
        assert (ef.successor(sought) == place).all()
        assert (ef.find(sought) == np.where(np.isin(sought, values), place, -1)).all()


@pytest.mark.parametrize("bits", [1, 7, 32, 33, 50, 63])
def test_low_bits_over_word_borders(bits):
    values = np.sort(np.random.default_rng(bits).integers(0, 40 << bits if bits < 58 else 2**63 - 1, 41).astype(np.uint64))
    ef = EliasFano(EliasFano.build(values, "x_"), "x_")
    at = np.arange(41)
    assert (ef.at(at) == values).all() and (at == np.arange(41)).all()
    assert (values[ef.find(values)] == values).all()


@pytest.mark.parametrize("n,blocks,v", [(1, 1, 10), (5, 3, 4), (64, 2, 300), (1000, 2, 50257), (5000, 1, 50257), (3000, 3, 2)])
def test_range_coder_round_trip(n, blocks, v):
    x = np.random.default_rng(n).integers(0, v, (blocks, n))
    if n >= 1000:
        x[:, 300:600] = x[:, :300]
    coded = token_files.encode_blocks(x, v)
    assert all((a == b).all() for a, b in zip(x, token_files.decode_blocks(coded)))
    assert [b for b in token_files.encode_blocks(x[:1], v)] == coded[:1]
    broken = bytearray(coded[0])
    broken[16] ^= 1
    with pytest.raises(ValueError):
        token_files.decode_blocks([bytes(broken)])


def test_coder_learns_repeats():
    x = np.tile(np.random.default_rng(0).integers(0, 50257, 2000), 66)[None, : 1 << 17]
    assert len(token_files.encode_blocks(x, 50257)[0]) < 0.25 * 2 * x.size


def test_library_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, library = token_files.LibraryEncoder(path), Tokenizer.from_file(path)
    some = [*texts(800, seed=9), "a <|endoftext|> b", "<|endoftext|>", "don't.\nStop 'stuff' x\n\ny\r\n z", "it's 5,000.5 \x1fa \x85b", "w" * 9000, ""]
    want = [library.encode(t, add_special_tokens=False).ids for t in some]
    flat, sizes = ours.encode_column(pa.array([*some, None]), 7)
    assert sizes.tolist() == [*(len(w) + 1 for w in want), 1]
    assert flat.tolist() == [i for w in [*want, []] for i in [*w, 7]]
    for t, w in zip(some, want):
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == w
    assert 50256 in want[800]


def test_packed_runs_have_even_blocks(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 500)
    for n in (0, 1, 499, 700, 750, 2600, 9001):
        x = np.random.default_rng(n).integers(0, 300, n) ** 2 // 300
        blocks = token_files.pack(x, 300)
        assert np.array_equal(np.concatenate([*token_files.decode_blocks(blocks), np.empty(0, np.int64)]), x)


def test_units_are_coded_in_place_of_ids():
    """The coder has one symbol for each unit, not one for each id, and gives back the same ids."""
    rng = np.random.default_rng(8)
    sizes = rng.integers(0, 6, 900)
    ids, which = rng.integers(0, 50257, sizes.sum()), rng.integers(0, 900, 20000) ** 2 // 900
    want = [i for k in which for i in ids[sizes[:k].sum() : sizes[: k + 1].sum()]]
    units, blocks = token_files.pack_units(which, sizes, ids, 50257)
    assert sum(token_files.HEAD.unpack_from(b)[1] for b in blocks) == 20000 < len(want)
    assert token_files.unpack_units(units, blocks).tolist() == want
    with pytest.raises(ValueError):
        token_files.unpack_units(units[:-1] + bytes([units[-1] ^ 1]), blocks)
    # Units that hardly recur: the ids themselves are coded.
    units, blocks = token_files.pack_units(np.arange(900), sizes, ids, 50257)
    assert units == b"" and token_files.unpack_units(units, blocks).tolist() == ids.tolist()
    assert token_files.unpack_units(*token_files.pack_units(which[:0], sizes[:0], ids[:0], 50257)).tolist() == []


def test_carries_and_skewed_symbols_round_trip():
    for v, odds in ((2, [0.999, 0.001]), (3, [0.5, 0.5, 0]), (300, None)):
        x = np.random.default_rng(v).choice(v, 60000, p=odds)
        (block,) = token_files.encode_blocks(x[None], v)
        assert np.array_equal(token_files.decode_blocks([block])[0], x)
    with pytest.raises(ValueError):
        token_files.encode_blocks(np.zeros((1, 2_100_000), np.int64), 300)


def test_unit_memory_is_bounded_and_changes_no_ids(monkeypatch):
    monkeypatch.setattr(token_files, "UNIT_MEMORY", 40)
    monkeypatch.setattr(token_files, "TEXT", 3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, library = token_files.LibraryEncoder(path), Tokenizer.from_file(path)
    for seed in range(6):
        some = [*texts(60, seed=seed), " one two  three <|endoftext|> two\n one", "", "\n"]
        flat, sizes = ours.encode_column(pa.array(some))
        want = [library.encode(t, add_special_tokens=False).ids for t in some]
        assert flat.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
        assert len(ours.units) == len(ours.sizes) and ours.sizes.sum() == len(ours.ids)


def test_recurrent_gradients():
    m = language_id.ByteTagger(["a", "b", "c"], hidden=3)
    for d in (m.forward, m.backward):
        for k in d.names:
            setattr(d, k, getattr(d, k).astype(np.float64))
    m.out, m.bias = m.out.astype(np.float64), m.bias.astype(np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(95, 100, (7, 5)), rng.integers(0, 3, 5)
    x[5:, 2] = 256
    _, grads = m.loss_and_gradients(x, y)
    for p, g in zip(m.parameters(), grads):
        for _ in range(6):
            i = tuple(int(rng.integers(95, 100)) if s == 257 else int(rng.integers(0, s)) for s in p.shape)
            old = p[i]
            p[i] = old + 1e-3
            a = m.loss_and_gradients(x, y)[0]
            p[i] = old - 1e-3
            b = m.loss_and_gradients(x, y)[0]
            p[i] = old
            assert abs((a - b) / 2e-3 - g[i]) < 1e-4


def test_ordinal_grades_are_ordered():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 900)
    names = {0: "awful", 1: "plain", 2: "lovely"}
    docs = [[names[g], *(f"w{rng.integers(0, 50)}" for _ in range(20))] for g in y]
    rows = [np.array([f for w in set(d) for f in ordinal.word_features(w.encode())]) for d in docs]
    m = ordinal.fit(rows[:600], y[:600], 3)
    scores = np.array([m.weights[r].sum() for r in rows[600:]])
    expected = m.tails(scores).sum(axis=1)
    mean = [expected[y[600:] == g].mean() for g in range(3)]
    assert mean[0] < 0.6 < mean[1] < 1.5 < mean[2] and (np.diff(m.thresholds) >= 0).all()


def test_tokens_of_a_column(monkeypatch):
    texts = ["One two  ONE", None, "", "three\tone\x0btwo\x0c\r\n", " \x1cx\u00a0Y\u2003z \u00c0b ", "e", "nd", "\n", "two"]
    hashed, digest = [], ngram_lm.xxhash.xxh64_intdigest
    monkeypatch.setattr(ngram_lm.xxhash, "xxh64_intdigest", lambda x: hashed.append(x) or digest(x))
    for some in (texts, texts[:1], texts[1:3], [], texts[::-1]):
        hashed.clear()
        column = pa.array(["before", *some, "after"], pa.string()).slice(1, len(some))
        hashes, which, counts = ngram_lm.tokens_of(column)
        words = [(t or "").encode().lower().split() for t in some]
        assert hashes[which].tolist() == [h for w in words for h in (*map(digest, w), ngram_lm.END)]
        assert counts.tolist() == [len(w) + 1 for w in words]
        # Each word is hashed once; every occurrence was.
        assert sorted(hashed) == sorted({x for w in words for x in w})
