import glob
import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxledger.llm import codebooks as op

SCHEMA = "vec_id long, embedding array<float>, label int, q string, code string, error int"


def table(spark, rows, folder):
    spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def plain(rows):
    """All entries are scanned for every part. Rows are (vec_id, vector, label), all of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = np.floor(1024 * np.array([np.pad(r[1], (0, -len(r[1]) % 4)) for r in rows], np.float32).astype(float)).astype(np.int64)
    parts = np.split(q, 4, axis=1)
    books = [p[:256].copy() for p in parts]

    def nearest(p, b):
        d = ((p[:, None, :] - b[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(4):
        for p, b in zip(parts, books, strict=True):
            at, _ = nearest(p, b)
            for e in set(at.tolist()):
                b[e] = [sum(col) // len(col) for col in p[at == e].T.tolist()]
    last = [nearest(p, b) for p, b in zip(parts, books, strict=True)]
    error = sum(d for _, d in last).tolist()
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    total = {}
    for r, e in zip(rows, error, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted((str(r[0]), "".join(f"{a[i]:02x}" for a, _ in last), error[i], total[r[2]], sha) for i, r in enumerate(rows))


def found(spark, folder):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in op.op13_vector_codes(spark, folder).collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(0, 10**6), st.sampled_from([3, 50, 1 << 20]))
def test_search_equals_a_scan_of_all_entries(entries, width, seed, span):
    rng = np.random.default_rng(seed)
    book = rng.integers(-span, span, (entries, width))
    points = rng.integers(-span, span, (70, width))
    all_d = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
    best, least = op.Codebook(book).nearest(points, rng.integers(0, entries, 70))
    assert best.tolist() == all_d.argmin(axis=1).tolist() and least.tolist() == all_d.min(axis=1).tolist()


def test_distances_are_exact_beyond_doubles():
    a, b = np.array([[1 << 24, -(1 << 24), 3]]), np.array([[-(1 << 24), (1 << 24) - 1, 0]])
    assert op.squared(a, b)[0, 0] == (1 << 25) ** 2 + ((1 << 25) - 1) ** 2 + 9


@pytest.mark.parametrize("length", [16, 10, 3])
def test_query_against_a_plain_version(spark, tmp_path, length):
    rng = np.random.default_rng(length)
    spots = rng.normal(size=(30, length))
    rows = [(i, (spots[i % 30] + 0.05 * rng.normal(size=length)).tolist(), None if i % 7 == 0 else i % 3) for i in range(700)]
    rows += [(5, rows[5][1], 1)] * 40 + [(None, rows[8][1], 2)] * 2 + [(3000 + i, [0.0] * length, 1) for i in range(5)]
    bad = [(1, None, 1), (2, [], 1), (3, [None] * length, 1), (4, [float("nan")] * length, None), (5, [1.0] * (length + 1), 1)]
    assert found(spark, table(spark, rows + bad, tmp_path)) == plain(rows)


def test_fewer_vectors_than_entries(spark, tmp_path):
    rows = [(9, [1.0, -1.0, 0.5, 0.25], 1), (3, [1.0, -1.0, 0.5, 0.25], 1), (4, [-0.001, 0.0, 0.0, 7.0], None)]
    assert found(spark, table(spark, rows, tmp_path)) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert found(spark, table(spark, [], tmp_path)) == []


def test_sql_on_a_table_and_a_fixture(spark, small, tmp_path):
    rng = np.random.default_rng(1)
    odd = table(spark, [(i // 2, rng.normal(size=8).tolist(), None if i % 5 == 0 else i % 2) for i in range(400)] + [(1, None, 1), (2, [1.0] * 4, 2)], tmp_path)
    for folder in (small, odd):
        con = duckdb.connect()
        files = glob.glob(f"{folder}/embeddings.parquet/*.parquet") or [f"{folder}/embeddings.parquet"]
        con.execute(f"create view embeddings as select * from read_parquet({files})")
        assert found(spark, folder) == sorted((str(r[0]), *r[1:]) for r in con.sql(op.ORACLE).fetchall())
