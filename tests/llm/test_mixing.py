import math

import pytest
from pyspark.sql import functions as F

from voxledger.llm import mixing

SCHEMA = "doc_id long, source string, text string, size int"


def plain_targets(sizes):
    """Share by weight, cap, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] >= 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def rows(n=600):
    out = [(i, f"s{(i * i) % 7}" if i % 3 else "hot", "w " * ((i * 37) % 50), 1) for i in range(n)]
    return out + [(n, None, "a b", 1), (n + 1, None, None, 1), (n + 2, "s1", "", None), (None, "s2", "x y z", 1), (5, "s4", "again", 1), (5, "s4", "again", 1)]


def test_targets_copies_and_reruns(spark):
    table = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = mixing.mix(table).collect()
    assert len(got) == len(rows())
    sizes, taken, target = {}, {}, {}
    for r in got:
        source, n = r["row"]["source"], len((r["row"]["text"] or "").split())
        assert r["size"] == n and 0 <= r["copies"] <= 3
        sizes[source] = sizes.get(source, 0) + n
        taken[source] = taken.get(source, 0) + n * r["copies"]
        target[source] = r["target"]
    want = plain_targets(sizes)
    for s in want:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 3 * 50
    key = lambda r: (*map(str, r["row"]), r["copies"])
    for parts, slots in ((3, 16), (7, 512)):
        again = mixing.mix(table.repartition(parts), slots=slots).collect()
        assert sorted(map(key, got)) == sorted(map(key, again))


def test_repeated_and_null_ids_take_the_same_copies_in_any_order(spark):
    many = [(i % 3 or None, "a", " ".join(["w"] * (1 + i % 11)), i) for i in range(300)]
    runs = []
    for seed in range(4):
        table = spark.createDataFrame(many, SCHEMA).orderBy(F.rand(seed)).repartition(seed + 1)
        taken = mixing.mix(table).groupBy("row.doc_id", "row.text").agg(F.sum("copies").alias("n")).collect()
        runs.append({(r["doc_id"], r["text"]): r["n"] for r in taken})
    assert all(r == runs[0] for r in runs)


def test_no_slot_holds_a_hot_source(spark):
    table = spark.range(4000).select("id", F.lit("hot").alias("source"), F.concat_ws(" ", F.lit("same size"), "id").alias("text"))
    for ids in (F.col("id"), F.lit(None).cast("long")):
        rows = mixing._dealt(mixing.sized(table.select(ids.alias("doc_id"), "source", "text")), 64)
        assert rows.groupBy("__group", "__class", "__slot").count().agg(F.max("count")).first()[0] < 4000 / 20


def test_clashing_names_and_long_texts(spark):
    names = ["row", "size", "copies", "target", "source_size", "__size", "__rank", "__row", "__before", "__group", "id", "hash", "n"]
    table = spark.createDataFrame([(i, "s", "w " * (200_000 if i == 7 else i), *names) for i in range(20)], ["doc_id", "source", "text", *names])
    out = mixing.emit(table)
    assert out.columns == table.columns
    assert {tuple(r)[3:] for r in out.collect()} == {tuple(names)}


def test_emit_repeats_rows_and_keeps_columns(spark):
    table = spark.createDataFrame(rows(), SCHEMA)
    out = mixing.emit(table)
    assert out.columns == table.columns
    copies = mixing.mix(table).agg(F.sum("copies")).first()[0]
    assert out.count() == copies


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, "a", None, 1), (2, None, " ", 1)], SCHEMA)).collect()
    assert {(r["size"], r["target"], r["copies"]) for r in got} == {(0, 0.0, 0)}


def test_equal_rows_are_parted_and_each_counted_once(spark):
    """A third of all rows are equal in all columns: no task of the mix holds them all, and none is lost."""
    rows = [(7, "hot", "one two three", 1)] * 3000 + [(i, f"s{i % 3}", "w " * (i % 40), 1) for i in range(6000)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(16)
    got = mixing.mix(table, slots=4)
    assert got.count() == len(rows)
    most = got.where("row.doc_id = 7").groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert most <= 2000
    taken = got.groupBy("row.source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 60 for r in taken)


def test_offsets_leave_the_least_error(spark):
    """Against a plain loop over all offsets, with equal rows counted together."""
    counts = [("a", 0.25, 0.4, 260.0, [(3, 10), (1, 200), (7, 11), (2, 60)]), ("b", 0.875, 2.5, 90.0, [(1, 5), (4, 9), (1, 1)]), ("c", 0.0, 0.0, 0.0, [(2, 0)])]
    rows, want = [], {}
    for group, first, each, target, runs in counts:
        before, sizes = 0, []
        for n, size in runs:
            rows.append((group, first, each, target, before, n, n * size))
            before, sizes = before + n, sizes + [size] * n
        tried = []
        for i in range(mixing.OFFSETS):
            u = (first + i / mixing.OFFSETS) % 1
            tried.append((abs(sum((math.floor((k + 1) * each + u) - math.floor(k * each + u)) * s for k, s in enumerate(sizes)) - target), i, u))
        want[group] = min(tried)[2]
    table = spark.createDataFrame(rows, "__group string, __first double, __each double, __target double, __before long, __n long, __size long")
    assert {r["__group"]: r["__offset"] for r in mixing._offsets(table).collect()} == want


def test_sources_of_few_documents_come_near_their_targets(spark, medium):
    got = mixing.op5_mix_sources(spark, medium).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(0.89 <= r["taken"] / r["target"] <= 1.03 for r in got)
