from fractions import Fraction

import numpy as np
import pytest

from voxledger.llm import whitening as op

SCHEMA = "vec_id long, embedding array<float>, label int, x int, deviation string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "y") for i, v in rows], SCHEMA)


def vectors(rows, length, seed=0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(length, length)) * np.linspace(0.2, 2, length)
    return (rng.normal(size=(rows, length)) @ mix).astype(np.float32)


def check(got, data, ids):
    """Every column against plain numpy and exact whole numbers."""
    x = np.floor(64 * data.astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (x - sums // n) - np.array([float(Fraction(int(s % n), n)) for s in sums])
    cov = centred.T @ centred / n
    values, turn = np.linalg.eigh(cov)
    values, turn = values[::-1], turn[:, ::-1]
    by = {(r["vec_id"], r["component"]): r for r in got}
    top = min(32, x.shape[1])
    assert len(got) == len(by) == n * top
    for c in range(top):
        want = centred @ turn[:, c] / np.sqrt(values[c])
        have = np.array([by[i, c + 1]["whitened"] for i in ids])
        sign = np.sign(want @ have)
        assert np.allclose(sign * have, want, atol=1e-8)
        assert by[ids[0], c + 1]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
    for k, i in enumerate(ids):
        assert by[i, 1]["deviation"] == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[k], sums, strict=True))
        assert by[i, 1]["n"] == n
    assert 0 <= got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize(("length", "tile"), [(64, 32), (40, 16), (8, 32), (33, 7)])
def test_whitening_against_numpy(spark, length, tile):
    data = vectors(300, length)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    bad = [(1000, None), (1001, []), (1002, [1.0] * (length - 1)), (1003, [None] * length), (1004, [float("nan")] * length), (1005, [float("-inf")] + [1.0] * (length - 1))]
    got = op.whiten(frame(spark, rows + bad).repartition(5), tile=tile).collect()
    check(got, data, list(range(300)))


def test_row_blocks_do_not_change_the_covariance(spark, monkeypatch):
    data = vectors(500, 20, 3)
    rows, _ = op.scaled(frame(spark, [(i, v.tolist()) for i, v in enumerate(data)]).repartition(4))
    want = op.fit(rows, tile=32).covariance
    monkeypatch.setattr(op, "ROWS", 17)
    assert np.allclose(op.fit(rows, tile=6).covariance, want, rtol=1e-12, atol=1e-12)


def test_dimensions_without_variance(spark):
    data = vectors(50, 6, 1)
    data[:, 2] = 0.5
    got = op.whiten(frame(spark, [(i, v.tolist()) for i, v in enumerate(data)])).collect()
    last = [r for r in got if r["component"] == 6]
    assert {r["whitened"] for r in last} == {0.0} and got[0]["identity_error"] < 1e-9 and abs(last[0]["explained"]) < 1e-12
    one = op.whiten(frame(spark, [(7, [1.0, 2.0])])).collect()
    assert [(r["vec_id"], r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(7, 1, 0, 0.0, 0.0)] * 2


def test_repeated_rows_and_null_ids_stay(spark):
    data = vectors(40, 4, 2)
    rows = [(None if i % 5 == 0 else i % 3, v.tolist()) for i, v in enumerate(data)] + [(1, data[1].tolist())] * 3
    assert len(op.whiten(frame(spark, rows)).collect()) == 43 * 4


def test_large_deviations_are_exact_or_an_error(spark):
    data = np.array([[1e6, 0.0], [-1e6, 0.25], [3.0, 0.5]], np.float32)
    check(op.whiten(frame(spark, [(i, v.tolist()) for i, v in enumerate(data)])).collect(), data, [0, 1, 2])
    with pytest.raises(Exception, match="too large"):
        op.whiten(frame(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])])).collect()


def test_empty_table(spark):
    got = op.whiten(frame(spark, []))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_query_against_numpy(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(op.op12_embedding_whitening(spark, small).collect(), np.array([r["embedding"] for r in rows], np.float32), [r["vec_id"] for r in rows])
