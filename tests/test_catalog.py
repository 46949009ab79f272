"""Every registered log query against its DuckDB form, and the contract of the entry module."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from voxledger.plans import catalog


def norm(v):
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, small, name):
    df = catalog.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_entry_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_results_do_not_depend_on_partitions(spark, small):
    for name in ("timeline_partition", "physical_lines", "multiline_blocks", "link_components", "top_counters"):
        seen = []
        for n in ("1", "8"):
            old = spark.conf.get("spark.sql.shuffle.partitions")
            spark.conf.set("spark.sql.shuffle.partitions", n)
            try:
                seen.append(sorted(map(tuple, catalog.QUERIES[name](spark, small).collect())))
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", old)
        assert seen[0] == seen[1]


def test_pii_detect_equals_the_detectors_over_all_texts(spark, small):
    from collections import Counter

    from voxledger.operators import sanitize

    want = Counter()
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        want.update((r["doc_id"], kind) for kind, *_ in sanitize.detect(r["text"] or "", join=True))
    assert {(r["doc_id"], r["type"]): r["n"] for r in catalog.pii_detect(spark, small).collect()} == dict(want)
