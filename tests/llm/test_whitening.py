"""Embedding whitening against numpy."""

import numpy as np
import pytest

from askgrid.llm import whitening


def expected(vectors, components=4):
    """Rows of (deviation, [whitened], [explained]) for each vector, whitened up to its sign."""
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    variance, axes = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))
    variance, axes = variance[::-1], axes[:, ::-1]
    kept = int((variance[:components] > 1e-12 * variance[0]).sum())
    y = (x - sums / n) @ axes[:, :kept] / np.sqrt(variance[:kept])
    return n, ((n * x - sums) ** 2).sum(1), y, variance[:kept] / variance.sum()


def check(result, ids, vectors):
    n, deviation, y, explained = expected(vectors)
    got = {}
    for r in result.collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
        assert r["n"] == n and r["identity_error"] <= 1e-9
    assert sorted(got) == sorted(ids)
    signs = None
    for i, vec_id in enumerate(ids):
        rows = [got[vec_id][c + 1] for c in range(y.shape[1])]
        assert len(got[vec_id]) == y.shape[1]
        assert all(r["deviation"] == deviation[i] for r in rows)
        assert np.allclose([r["explained"] for r in rows], explained, rtol=1e-9)
        mine = np.array([r["whitened"] for r in rows])
        if signs is None or (np.abs(mine) < 1e-6).any():
            signs = np.sign(mine * y[i]) if signs is None else signs
        assert np.allclose(mine * signs, y[i], atol=1e-7)


@pytest.fixture
def table(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, label INT")
        for name in ("_x", "n", "index", "vector", "component", "_index"):
            df = df.withColumn(name, df["label"])
        return df

    return make


def test_random_vectors_with_copies(table, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 7 * 20)  # many blocks
    monkeypatch.setattr(whitening, "BLOCKS_PER_TASK", 2)
    chosen = np.random.default_rng(1)
    vectors = (chosen.normal(size=(300, 7)) * [3, 1, 0.5, 2, 0.1, 1, 1]).astype(np.float32).tolist()
    vectors += [vectors[0]] * 150 + [vectors[5]] * 3
    check(whitening.whiten(table([(i, v, 0) for i, v in enumerate(vectors)])), range(len(vectors)), vectors)


def test_bad_rows_are_left_out(table):
    good = np.random.default_rng(2).normal(size=(40, 3)).astype(np.float32).tolist()
    bad = [None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [1.0, float("inf"), 1.0], [float("-inf"), 0.0, 0.0]]
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(100 + i, v, 1) for i, v in enumerate(bad)]
    result = whitening.whiten(table(rows))
    check(result, range(40), good)
    assert {"label", "index", "vector", "_index"} <= set(result.columns)


def test_fewer_dimensions_than_components(table):
    line = [[float(i), 2.0 * i, -1.0 * i] for i in range(9)]
    check(whitening.whiten(table([(i, v, 0) for i, v in enumerate(line)])), range(9), line)
    one = [[0.5], [0.25], [-4.0]]
    check(whitening.whiten(table([(i, v, 0) for i, v in enumerate(one)])), range(3), one)


def test_shorter_vectors_repeated_rows_and_null_ids(table):
    full = np.random.default_rng(4).normal(size=(20, 3)).astype(np.float32).tolist()
    rows = [(i, v, 0) for i, v in enumerate(full)] + [(20, [0.5], 0), (21, [], 0)]
    check(whitening.whiten(table(rows)), range(22), [*full, [0.5, 0, 0], [0, 0, 0]])
    twice = whitening.whiten(table([*rows, rows[0], (None, full[1], 0)]))
    assert twice.where("vec_id = 0").count() == 6 and twice.where("vec_id is null").count() == 3


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]])
def test_nothing_to_whiten(table, rows):
    result = whitening.whiten(table(rows))
    assert result.count() == 0
    assert {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"} <= set(result.columns)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    result = whitening.op11_whitening(spark, folder)
    assert dict(result.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
        "explained": "double", "identity_error": "double",
    }
    check(result, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])
