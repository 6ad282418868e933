"""The trained tagger against enumeration of all paths, and on held-out texts."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.functions import rules
from hushframe.operators import crf, evaluate
from hushframe.plans import registry


def weights(seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return crf.Weights(np.zeros((crf.BUCKETS, crf.N)), scale * rng.standard_normal((crf.N, crf.N)), scale * rng.standard_normal(crf.N))


def path_score(scores, path, w):
    return w.first[path[0]] + sum(scores[t, y] for t, y in enumerate(path)) + sum(w.step[a, b] for a, b in zip(path, path[1:]))


def test_marginals_and_best_path_are_those_of_all_paths():
    rng, w = np.random.default_rng(1), weights(2)
    sizes = np.array([3, 2, 2, 1])
    each = [3 * rng.standard_normal((n, crf.N)) for n in sizes]
    laid, live = crf._laid_out(np.concatenate(each), np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    total, p, _ = crf.marginals(laid, live, w)
    best = crf.viterbi(laid, live, w)
    for lane, scores in enumerate(each):
        paths = list(itertools.product(range(crf.N), repeat=len(scores)))
        value = np.array([path_score(scores, y, w) for y in paths])
        z = np.log(np.exp(value - value.max()).sum()) + value.max()
        assert np.isclose(total[lane], z)
        chance = np.exp(value - z)
        for t in range(len(scores)):
            for label in range(crf.N):
                assert np.isclose(p[t, lane, label], sum(c for c, y in zip(chance, paths) if y[t] == label), atol=1e-12)
        assert tuple(best[: len(scores), lane]) == paths[int(value.argmax())]


def test_equal_paths_go_to_the_smaller_label():
    laid, live = crf._laid_out(np.zeros((4, crf.N)), np.array([0]), np.array([4]))
    assert crf.viterbi(laid, live, crf.Weights.none()).ravel().tolist() == [0, 0, 0, 0]


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(4)
    x = 0.3 * rng.standard_normal(len(crf.Weights.none().flat()))
    sizes = np.array([4, 0, 2, 5, 1])
    features = rng.integers(0, 40, (sizes.sum(), crf.Features.width)).astype(np.int32)
    args = (features, rng.integers(0, crf.N, sizes.sum()), np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes, rng.random(5) + 0.5)
    _, g = crf.gradient(*args, crf.Weights.of(x))
    cells = crf.BUCKETS * crf.N
    some = [*rng.integers(0, 40 * crf.N, 25).tolist(), *range(cells, cells + 30), *range(len(x) - crf.N, len(x))]
    for i in some:
        up, down = x.copy(), x.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (crf.gradient(*args, crf.Weights.of(up))[0] - crf.gradient(*args, crf.Weights.of(down))[0]) / 2e-5
        assert np.isclose(g[i], slope, rtol=1e-4, atol=1e-6)


def test_gold_labels_follow_the_entities():
    text = "key:AKIA12 a@b.org, x"
    ids = [rules.BIO[k] for k in crf.gold(text, [(11, 18, "EMAIL"), (4, 10, "CREDENTIAL")])]
    assert list(zip([p for *_, p in crf.pieces(text)], ids)) == [("key", "O"), (":", "O"), ("AKIA12", "B-CREDENTIAL"), ("a", "B-EMAIL"), ("@", "I-EMAIL"), ("b", "I-EMAIL"), (".", "I-EMAIL"), ("org", "I-EMAIL"), (",", "O"), ("x", "O")]
    # Two of a kind side by side: the second begins with B.
    assert [rules.BIO[k] for k in crf.gold("12 34", [(0, 2, "SSN"), (3, 5, "SSN")])] == ["B-SSN", "B-SSN"]
    assert crf.gold(None, []) == crf.gold("", []) == []


@pytest.fixture(scope="module")
def trained(spark):
    rows = crf.labelled(registry.annotated(spark, "/root/testdata/sf0.01").select("id", "text"))
    return rows, crf.train(rows.where("id % 3 != 0"))


def test_training_does_not_depend_on_partitions(spark, sf):
    rows = crf.labelled(registry.annotated(spark, sf).select("id", "text"))
    a, b = (crf.train(x, steps=3).flat() for x in (rows.coalesce(1), rows.repartition(7)))
    assert np.allclose(a, b, atol=1e-6) and np.abs(a).max() > 0


def test_held_out_texts(spark, trained, tmp_path):
    rows, w = trained
    crf.save(spark, w, str(tmp_path / "model"))
    again = crf.load(spark, str(tmp_path / "model"))
    assert np.allclose(again.flat(), w.flat(), atol=1e-5)
    found = crf.predicted(rows.where("id % 3 = 0"), again)
    ner = F.filter("spans", lambda s: s["source"].startswith("ner"))
    scores = {r.label: r for r in evaluate.entity_scores_of(found.select("id", "entities", ner.alias("ner")), "entities", "ner").collect()}
    assert scores["micro"].f1 > 0.82 and scores["PHONE"].f1 > 0.95 and scores["micro"].expected >= 500
    for r in found.collect():
        assert all(s.value == r.text[s.start : s.end] and 0.5 <= s.score <= 1 for s in r.spans)


def test_odd_rows(spark, trained):
    _, w = trained
    odd = [(1, None, 5), (2, "", 5), (3, "  \n ", 5), (4, "mail kim7@example.org now", 5), (4, "mail kim7@example.org now", 5), (5, "word " * 30000 + "mail kim7@example.org now", 5)]
    found = crf.predicted(spark.createDataFrame(odd, "id int, text string, entities int"), w).collect()
    assert len(found) == len(odd) and found[0].entities == 5
    spans = {r.id: [(s.label, s.value) for s in r.spans] for r in found}
    assert spans[1] == spans[2] == spans[3] == [] and spans[4] == [("EMAIL", "kim7@example.org")] == spans[5]
    assert crf.predicted(spark.createDataFrame([], "id int, text string"), w).count() == 0
    none = crf.train(spark.createDataFrame([], "text string, entities array<struct<start:int,end:int,label:string>>"))
    assert not none.flat().any()
    assert crf.predicted(spark.createDataFrame([(1, "a 1")], "id int, text string"), none).first().spans == []
    plain = crf.train(spark.createDataFrame([("no entity here", None)], "text string, entities array<struct<start:int,end:int,label:string>>"), steps=2)
    assert all(not x for x in crf.Tagger(plain)(["no entity here"]))
