"""op11 and op13 against brute force, with bad rows, ties, repeats, ragged vectors and hot groups."""

import random
from fractions import Fraction

import numpy as np
import pytest

from strandline.llm import negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, same string"
NAN, INF = float("nan"), float("inf")


def usable(row):
    return row[0] is not None and row[2] is not None and row[1] is not None and all(c is not None and np.isfinite(c) for c in row[1])


def whole(vector, dims):
    return [int(np.floor(256 * float(np.float32(c)))) for c in vector] + [0] * (dims - len(vector))


def brute_negatives(rows):
    rows = [r for r in rows if usable(r)]
    dims = max((len(r[1]) for r in rows), default=0)
    rows = [(r[0], whole(r[1], dims), (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2]) for r in rows]
    out = []
    for a, x, label in {(i, tuple(v), lab) for i, v, lab in rows if i % 100 == 0}:
        scored = sorted((-sum(p * q for p, q in zip(x, v, strict=True)), i, lab) for i, v, lab in rows if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            fit = [r for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def cluster(rng, centre, spread):
    return [c + rng.gauss(0, spread) for c in centre]


def made(rng, n, dims=8):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = [(i, cluster(rng, rng.choice(centres), 0.3), rng.randrange(4), 1, "x") for i in range(n)]
    rows += [(i, rows[3][1], i % 3, 1, "x") for i in range(n, n + n // 2)]  # copies: a third of all rows
    rows += [(100 * k, rows[3][1], 2, 1, "x") for k in range(40, 44)]
    return rows


BAD = [(7001, None, 1, 0, ""), (7002, [1.0, None], 1, 0, ""), (7003, [NAN, 1.0], 1, 0, ""), (7004, [INF, 1.0], 1, 0, ""), (7005, [1.0], None, 0, ""), (None, [1.0], 1, 0, ""), (7100, [], 1, 0, ""), (7200, [3e38, -3e38], 2, 0, "")]


def mined(spark, rows, monkeypatch=None):
    return sorted(tuple(r)[:6] for r in negatives.mined(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())


def test_negatives_match_brute_force(spark):
    rows = made(random.Random(1), 260)
    assert mined(spark, rows) == brute_negatives(rows)


def test_blocks_slices_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 2)
    monkeypatch.setattr(negatives, "SLICE_ROWS", 40)
    monkeypatch.setattr(negatives, "PIVOTS", 5)
    rows = made(random.Random(2), 150)
    rows += rows[:20] + [(200, rows[5][1], 1, 0, "again")]
    assert mined(spark, rows) == brute_negatives(rows)


def test_bounds_prune_and_lose_nothing(spark):
    """Tight, far clusters: most rows serve one group alone, and the result stays whole."""
    rng = random.Random(3)
    far = [[10.0 if k == c else 0.0 for k in range(6)] for c in range(6)]
    rows = [(i * 10, cluster(rng, far[i % 6], 0.05), i % 2, 0, "") for i in range(240)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_bad_rows_ragged_and_empty(spark):
    rows = [(i, [float(i % 5), 1.0][: 1 + i % 2], i % 2, 0, "") for i in range(0, 900, 50)]
    assert mined(spark, rows + BAD[:6]) == brute_negatives(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1, 0, "")]) == []
    mined(spark, rows + BAD)  # huge components are bounded, not an error


def brute_whitening(rows):
    rows = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    dims = max(len(r[1]) for r in rows)
    x = [whole(r[1], dims) for r in rows]
    distinct = sorted(set(map(tuple, x)))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    exact = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(r, sums, strict=True)] for r in distinct])
    cov = exact.T @ exact / n
    values, vectors = np.linalg.eigh(cov)
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(r, sums, strict=True)] for r in x])
    k = min(4, dims)
    return {
        "ids": [r[0] for r in rows],
        "n": n,
        "deviation": [sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x],
        "whitened": centred @ vectors[:, ::-1][:, :k] / np.sqrt(values[::-1][:k]),
        "explained": values[::-1][:k] / values.sum(),
    }


def test_whitening_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + k) for k in range(6)][: 5 + i % 2], i, 0, "") for i in range(200)]
    rows += [(1000 + i, rows[0][1], 1, 0, "") for i in range(100)] + BAD[:4]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(4)).toPandas().sort_values(["vec_id", "component"])
    want = brute_whitening(rows)
    order = np.argsort(want["ids"])
    assert (got["n"] == want["n"]).all()
    assert got["deviation"].tolist() == [want["deviation"][i] for i in order for _ in range(4)]
    ours, theirs = got["whitened"].to_numpy().reshape(-1, 4), want["whitened"][order]
    signs = np.sign((ours * theirs).sum(axis=0))  # one sign a component, for all rows
    assert np.abs(ours * signs - theirs).max() < 1e-9
    assert np.abs(got["explained"].to_numpy().reshape(-1, 4) / want["explained"] - 1).max() < 1e-12
    assert got["identity_error"].max() < 1e-9


@pytest.mark.parametrize("rows", [[], BAD[:4]])
def test_whitening_of_nothing(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_whitening_without_variance(spark):
    out = whitening.whitened(spark.createDataFrame([(None, [1.0, 2.0], 1, 0, "")] * 3, SCHEMA)).collect()
    assert len(out) == 6 and {(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in out} == {(None, 1, 0, 0.0, 0.0, 1.0)}
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 0.0], 1, 0, "") for i in range(4)], SCHEMA)).collect()
    assert sorted({(r.component, round(r.explained, 9)) for r in line}) == [(1, 1.0), (2, 0.0)]


def test_whitening_of_huge_components(spark):
    """Components are bounded at 2**26; a deviation is exact up to a long and null beyond."""
    top = 1 << 26
    for n in (2, 40, 400):
        x = [(top if i % 2 else -top, i) for i in range(n)]
        sums = [sum(c) for c in zip(*x, strict=True)]
        out = whitening.whitened(spark.createDataFrame([(i, [3e38 * (1 if i % 2 else -1), i / 256], 1, 0, "") for i in range(n)], SCHEMA)).filter("component = 1").collect()
        for r in out:
            exact = sum((n * v - s) ** 2 for v, s in zip(x[r.vec_id], sums, strict=True))
            assert r.deviation == (exact if exact < 1 << 63 else None)
