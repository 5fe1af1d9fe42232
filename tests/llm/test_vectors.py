"""Nearest neighbours, hard negatives and whitening against brute force, with rows of every bad kind."""

import numpy as np
import pytest

from piste.llm import hard_negatives, multi_index, whitening
from piste.llm.common import table

SF = "/root/testdata/sf0.1"
COLUMNS = "vec_id long, embedding array<double>, label int, block int, kind int, score double, cell int, x string"


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, l, 1, 2, 0.5, 3, "x") for i, v, l in rows], COLUMNS)

    return make


def some_rows(n=600, d=12, seed=3):
    """Random rows, a third of them one vector, near copies, and rows that take no part."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x[: n // 3] = x[0]
    x[n // 3 : n // 3 + 20] = x[1] + 0.01 * rng.standard_normal((20, d))
    good = [(i, x[i].tolist(), int(i * i % 10)) for i in range(n)]
    bad = [(1000, None, 1), (1050, [], 1), (1100, [0.0] * d, 1), (1150, [float("nan")] + [1.0] * (d - 1), 2), (1200, [None] + [1.0] * (d - 1), 2),
           (1250, [float("inf")] * d, 3), (1300, [1.0] * (d + 1), 4), (None, [1.0] * d, 5), good[50], good[100]]
    return good, bad, x


def exact_neighbours(x, ids, every, k):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = multi_index.cosine(x[q], x)
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_search_equals_brute_force_with_hot_vectors_and_unusable_rows(vectors):
    good, bad, x = some_rows()
    got = grouped(multi_index.search(vectors(good + bad), recall=1.0, block=64, cell_rows=16).collect())
    assert got == exact_neighbours(x, np.arange(len(x)), 50, 5)


def test_search_measures_recall_on_a_part_of_the_queries(spark):
    emb = table(spark, SF, "embeddings")
    rows = emb.orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    truth = exact_neighbours(multi_index.scaled(x), ids, 50, 5)
    got = grouped(multi_index.search(emb, tuning=10, recall=0.95).collect())
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in truth[q]}) for q in truth)
    assert hits / sum(map(len, truth.values())) >= 0.9
    for q, found in got.items():
        assert len(found) == 5
        score = dict(zip(ids.tolist(), multi_index.cosine(multi_index.scaled(x)[q], multi_index.scaled(x)).tolist()))
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and all(score[v] == s for v, s in found)


def test_search_of_few_rows_and_extreme_lengths(vectors):
    assert multi_index.search(vectors([])).count() == 0
    assert multi_index.search(vectors([(0, [1.0, 2.0], 1)])).count() == 0
    got = grouped(multi_index.search(vectors([(0, [1e300, 0.0], 1), (50, [2e-300, 1e-300], 1), (7, [0.0, 3.0], 1)])).collect())
    assert [v for v, _ in got[0]] == [50, 7] and [v for v, _ in got[50]] == [0, 7]
    assert got[0][0][1] == pytest.approx(0.8**0.5, abs=1e-15)


def test_walk_meets_every_pair_once_by_distance():
    rng = np.random.default_rng(1)
    one, two = rng.random(7), rng.random(5)
    got = list(multi_index.walk(one, two))
    assert sorted(c for _, c in got) == list(range(35)) and [d for d, _ in got] == sorted(d for d, _ in got)
    assert all(d == one[c // 5] + two[c % 5] for d, c in got)


def brute_negatives(rows, every=100):
    kept = {i: (np.floor(np.array(v) * 256).astype(np.int64), (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows}
    ids = np.array(sorted(kept))
    x, label = np.stack([kept[i][0] for i in ids]), np.array([kept[i][1] for i in ids])
    out = []
    for a in np.flatnonzero(ids % every == 0):
        s = x @ x[a]
        best = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != a and label[j] == label[a])[:5]
        for minus, p in best:
            ps = -minus
            ok = sorted((-s[j], ids[j]) for j in range(len(ids)) if label[j] != label[a] and 30 * ps <= 100 * s[j] <= 90 * ps)[:10]
            out += [(int(ids[a]), int(p), k + 1, int(n), int(ps), int(-m)) for k, (m, n) in enumerate(ok)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"block": 50, "sample": 30}, {"sample": 3}])
def test_negatives_equal_brute_force(vectors, options):
    good, bad, _ = some_rows()
    bad = [b for b in bad if b[0] != 1100] + [(1350, [1.0] * 12, None)]
    got = hard_negatives.mine(vectors(good + bad), every=20, **options).collect()
    assert sorted(map(tuple, got)) == brute_negatives(good, 20)


def test_negatives_of_given_table_and_of_empty_ones(spark, vectors):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, SF, "embeddings").collect()]
    assert sorted(map(tuple, hard_negatives.mine(table(spark, SF, "embeddings")).collect())) == brute_negatives(rows)
    assert hard_negatives.mine(vectors([])).count() == 0
    assert hard_negatives.mine(vectors([(100, [1.0, 2.0], 1), (3, [1.0, 2.0], 2)])).count() == 0


def test_scores_past_doubles_are_exact(vectors):
    big = float(2**40)
    rows = [(100, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big / 2, 3.0], 2), (3, [-big, 1.0], 2)]
    got = hard_negatives.mine(vectors(rows), block=2).collect()
    assert [(r["positive_score"], r["negative_score"]) for r in got] == [(2**63 - 1, 2**63 - 1)] or all(r["positive_score"] == 2**63 - 1 for r in got)
    mid = float(2**20)
    rows = [(100, [mid, 1.0], 1), (1, [mid, 2.0], 1), (2, [mid / 2, 3.0], 2)]
    got = hard_negatives.mine(vectors(rows)).collect()
    assert [(r["positive_score"], r["negative_score"]) for r in got] == [(2**56 + 2 * 65536, 2**55 + 3 * 65536)]


def test_index_leaves_dimensions_out_and_loses_no_row():
    rng = np.random.default_rng(5)
    x, anchors = np.floor(rng.standard_normal((300, 16)) * 64), np.floor(rng.standard_normal((9, 16)) * 64)
    limits = np.sort(x @ anchors.T, axis=0)[-12]
    index = hard_negatives.Index(x, anchors, limits)
    assert index.left_out.max() > 0 and index.ends[0] < len(x)
    for a, limit, (places, score) in zip(anchors, limits, index.reaching(anchors, limits)):
        assert set(places) == set(np.flatnonzero(x @ a >= limit)) and (score == x[places] @ a).all()


def whitened_by_numpy(x, k=4):
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return fit, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def check_whitening(rows, x, ids, tolerance):
    fit, values, vectors, trace = whitened_by_numpy(x)
    n, sums = len(fit), fit.sum(0)
    by_component = {}
    for r in rows:
        by_component.setdefault(r["component"], {})[r["vec_id"]] = r
        assert r["n"] == n and abs(r["identity_error"]) < 1e-9
    assert sorted(by_component) == list(range(1, len(values) + 1))
    for c, got in by_component.items():
        expected = (x - sums / n) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        found = np.array([got[i]["whitened"] for i in ids])
        sign = np.sign(found @ expected)
        assert np.abs(sign * found - expected).max() < tolerance
        assert got[ids[0]]["explained"] == pytest.approx(values[c - 1] / trace, rel=1e-9)
        assert [got[i]["deviation"] for i in ids] == [int(((n * v.astype(object) - sums.astype(object)) ** 2).sum()) for v in x.astype(np.int64)]


def test_whitening_equals_eigendecomposition(spark):
    emb = table(spark, SF, "embeddings")
    rows = emb.orderBy("vec_id").collect()
    x = np.floor(np.array([r["embedding"] for r in rows], float) * 256)
    check_whitening(whitening.whiten(emb).collect(), x, [r["vec_id"] for r in rows], 1e-7)


def test_whitening_fits_distinct_vectors_and_drops_unusable_rows(vectors):
    good, bad, x = some_rows()
    bad = [b for b in bad if b[0] is not None and b[0] >= 1000 and b[0] != 1100]
    got = whitening.whiten(vectors(good + bad + [good[5]])).collect()
    assert len(got) == 4 * (len(good) + 1)
    check_whitening(got, np.floor(x * 256), list(range(len(x))), 1e-9)


def test_whitening_of_few_or_flat_rows(vectors):
    assert whitening.whiten(vectors([])).count() == 0
    assert whitening.whiten(vectors([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0
    line = whitening.whiten(vectors([(i, [float(i), 2.0 * i, 1.0], 0) for i in range(5)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 5
    d = 40  # a flat spectrum: plus and minus each axis
    axes = [(2 * j + s, [0.0] * j + [1.0 - 2 * s] + [0.0] * (d - j - 1), 0) for j in range(d) for s in (0, 1)]
    got = whitening.whiten(vectors(axes), block=6, degree=4).collect()
    assert len(got) == 4 * 2 * d and max(r["identity_error"] for r in got) < 1e-9
    assert {round(r["explained"], 12) for r in got} == {round(1 / d, 12)}


def test_search_answers_rare_near_copies_among_far_queries(vectors):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 16))
    for q in range(0, 6000, 1000):  # six of 120 queries have near copies, the others only far neighbours
        x[q + 1 : q + 9] = x[q] + 0.02 * rng.standard_normal((8, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = grouped(multi_index.search(vectors(rows), tuning=60, first=20, cell_rows=16).collect())
    truth = exact_neighbours(x, np.arange(6000), 50, 5)
    assert set(got) == set(truth) and all(len(f) == 5 for f in got.values())
    assert all(got[q] == truth[q] for q in range(0, 6000, 1000))
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in truth[q]}) for q in truth) >= 0.95 * 5 * len(truth)
