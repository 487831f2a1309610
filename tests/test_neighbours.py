"""Nearest vectors of many queries against brute force, and the index's recall."""

import numpy as np
import pytest

from strandline.operators import neighbours


def brute(rows, asked, k):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and i is not None and np.isfinite(np.array(v, float)).all()]
    dims = max((len(v) for _, v in rows), default=1)
    pad = lambda v: np.pad(v, (0, dims - len(v)))
    cos = lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6) if (a @ a) * (b @ b) else 0.0
    return {q: [(p + 1, i, s) for p, (s, i) in enumerate(sorted(((cos(pad(x), pad(v)), i) for i, v in rows), key=lambda t: (-t[0], t[1]))[:k])] for q, x in dict(asked).items() for x in [np.array(x, np.float32).astype(float)]}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "place").collect():
        out.setdefault(r.query_id, []).append((r.place, r.vec_id, round(r.score, 6)))
    return out


SCHEMA = "vec_id long, embedding array<float>, label int"


def made(n, dims, seed, clusters=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims)) * 3 if clusters else None
    return [(i, (rng.normal(size=dims) + (centres[i % clusters] if clusters else 0)).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [8192, 3])
def test_exact_search(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "SLICE_ROWS", 50)
    rows = made(300, 7, 1) + [(900 + i, [1.0] * 7) for i in range(40)] + [(950, [0.0] * 7), (951, [2.0, 1.0])]
    bad = [(None, [1.0] * 7), (960, None), (961, []), (962, [float("nan")] * 7)]
    asked = rows[::20] + [(950, [0.0] * 7)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], SCHEMA).repartition(4)
    got = found(neighbours.nearest_to_many(df, spark.createDataFrame([(i, v, 0) for i, v in asked + asked[:3]], SCHEMA)))
    assert got == brute(rows, asked, 8)


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_of_the_index(spark, clusters):
    """Without any structure most cells are probed, with clusters few; either way nine of ten neighbours and more are found."""
    rows = made(3000, 16, 2, clusters)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    asked = df.filter("vec_id % 20 = 0")
    index = neighbours.fit(df)
    exact, got = found(neighbours.nearest_to_many(df, asked)), found(neighbours.nearest_to_many(df, asked, index=index))
    hits = [len({i for _, i, _ in exact[q]} & {i for _, i, _ in got[q]}) / 8 for q in exact]
    assert np.mean(hits) >= 0.9 and len(got) == len(exact)
    assert index.probes < (neighbours.CELLS if not clusters else neighbours.CELLS // 2 + 1)


def test_index_with_all_cells_is_exact_and_empty_tables(spark):
    df = spark.createDataFrame([(i, v, 0) for i, v in made(200, 5, 3)], SCHEMA)
    index = neighbours.fit(df, cells=4)
    whole = neighbours.Index(index.centroids, len(index.centroids))
    assert found(neighbours.nearest_to_many(df, df.limit(30), index=whole)) == found(neighbours.nearest_to_many(df, df.limit(30)))
    none = df.limit(0)
    assert neighbours.nearest_to_many(none, df).count() == 0 and neighbours.nearest_to_many(df, none, index=neighbours.fit(none)).count() == 0
