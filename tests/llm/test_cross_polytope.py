import duckdb
import numpy as np
import pytest

from voxledger.llm import cross_polytope as op

SCHEMA = "vec_id long, embedding array<float>, label int, n long, sig string, h0 int"


def plain(rows):
    """Links and least ids by comparing all pairs; rows are (vec_id, vector, label)."""

    def good(v, label):
        return label is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    arrays = [np.array(v, np.float32).astype(float) if good(v, label) else None for _, v, label in rows]
    for i, (_, _, a) in enumerate(rows):
        for j in range(i):
            x, y = arrays[i], arrays[j]
            if a == rows[j][2] and x is not None and y is not None and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (vec_id, _, _) in enumerate(rows):
        own = low.get(root(i))
        low[root(i)] = vec_id if own is None else own if vec_id is None else min(own, vec_id)
    return sorted((str(r[0]), links[i], str(low[root(i)]), r[0] == low[root(i)]) for i, r in enumerate(rows))


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in op.near_duplicates(df, **more).collect())


def groups(length, seed, label=1):
    """A group of near copies, chains of neighbours, and vectors of their own."""
    rng = np.random.default_rng(seed)
    rows, centre = [], rng.normal(size=length)
    for i in range(60):
        rows.append((i, (centre + 0.12 * rng.normal(size=length)).tolist(), label))
    for i in range(60, 100):
        rows.append((i, (rng.normal(size=length) * rng.uniform(0.1, 9)).tolist(), label))
    near = rng.normal(size=length)
    for i in range(100, 130):
        near = near + 0.1 * rng.normal(size=length)
        rows.append((i, (3 * near).tolist(), label))
    return rows


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = op.hadamard(x)
    assert np.allclose((y * y).sum(1), (x * x).sum(1)) and np.allclose(op.hadamard(y), x)


@pytest.mark.parametrize(("length", "classes"), [(64, 100), (64, 10**6), (64, 10**9), (48, 5000), (3, 100), (1, 10)])
def test_tables_miss_hardly_any_pair_at_the_least_cosine(length, classes):
    depth, tables = op.plan_of(length, classes)
    rng = np.random.default_rng(9)
    a = op.units(rng.normal(size=(3000, length)))
    side = rng.normal(size=a.shape)
    b = a if length == 1 else 0.98 * a + np.sqrt(1 - 0.98**2) * op.units(side - (side * a).sum(1)[:, None] * a)
    seen = np.zeros(len(a), bool)
    for t in range(tables):
        x, y = op.buckets(a, t, depth, op.PROBES), op.buckets(b, t, depth, op.PROBES)
        seen |= (x[:, :1] == y).any(1) | (y[:, :1] == x).any(1)
    assert seen.mean() >= 0.999


def test_links_and_components_on_fixtures(spark):
    first = groups(64, 1)
    rows = first + [(200 + i, v, 2) for i, v, _ in first[:20]] + [(300 + i, v, None) for i, v, _ in first[:5]]
    rows += [(3, first[3][1], 1)] * 4 + [(None, first[0][1], 1), (None, [9.0] * 64, 7), (None, [9.0] * 64, 7)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 64, 1), (403, [1.0, None] * 32, 1), (404, [float("nan")] * 64, 1), (405, [float("inf")] * 64, 1)]
    rows += [(406, None, 1), (407, first[0][1][:32], 1), (408, first[1][1][:32], 1), (409, [1e-30] * 64, 4), (410, [1e30] * 64, 4), (411, [-1.0] * 64, 4)]
    want = plain(rows)
    for bucket in (2048, 16):  # the second compares every bucket block by block
        assert found(spark, rows, bucket_rows=bucket) == want


def test_lengths_that_are_no_power_of_two(spark):
    for length in (1, 3, 20):
        rows = groups(length, length)
        assert found(spark, rows) == plain(rows)


def test_copies_are_one_class(spark):
    v = np.random.default_rng(2).normal(size=64).tolist()
    rows = [(i, v, 1) for i in range(3000)]
    got = found(spark, rows)
    assert len(got) == 3000 and {r[1:3] for r in got} == {(2999, "0")} and sum(r[3] for r in got) == 1


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, None), (2, [], 3)]) == [("1", 0, "1", True), ("2", 0, "2", True)]


def test_query_and_fixture_against_sql(spark, tmp_path):
    rows = groups(16, 4) + [(500, None, 1), (501, [0.0] * 16, 1), (502, [1.0] * 16, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(op.ORACLE).fetchall())
    assert sorted(map(tuple, op.op11_embedding_near_dedup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect())) == want
    assert sum(r[1] > 0 for r in want) > 50
