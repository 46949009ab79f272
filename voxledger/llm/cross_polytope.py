"""Operator 11: near duplicates among vectors, by cross-polytope hashing with verified pairs.

Hash: a unit vector is padded to a power of two and turned three times by random signs and a fast Hadamard
transform; its bucket is the nearest vertex of the cross-polytope, so the coordinate of the largest absolute value
and its sign. `depth` such hashes together are one table's bucket; every vector also probes the next likely
vertices. Two vectors are candidates in a table if either's own bucket is among the other's buckets. Depth follows
the number of vectors of a label; the number of tables follows from the share of pairs at exactly the least cosine
that a table misses (simulated for the vectors' length), so that all tables miss at most MISS of such pairs.
All pairs found are verified: cosine in double precision.

Equal vectors of a label are one class with a count, so copies cost one signature. A pair of classes may meet in
several buckets; it counts in the first of them (least table, then least bucket), which both rows' signatures tell
without any other task. A bucket over `bucket_rows` is cut into blocks and every two blocks are a bucket of their
own: it is compared whole, by many tasks. Tasks return the number of links of each row and a spanning forest, never
pairs.

Vectors that are null, empty, zero or have null or non-finite entries, and rows without a label, link with nothing:
0 links, a component of their own. Vectors of different lengths don't link. Rows that repeat a vec_id are vectors of
their own; a null vec_id names a component only if it has no other, and is kept then. An empty table gives an empty
one. Other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read_table, scratch
from .simhash import components
from .vectors import by_length, finite, matrix, with_fields

LEAST_COSINE = 0.98
#: Most buckets that a vector goes to in a table: its own and the next likely ones.
PROBES = 3
#: Share of the pairs at the least cosine that all tables together may miss.
MISS = 1e-5
#: Most vectors that a bucket of evenly spread ones should hold.
FILL = 1024
#: Most rows that a task compares at once.
BUCKET_ROWS = 2048
SEED = 11


# ---------------------------------------------------------------- hashing


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; divided by their largest entry first, so that nothing overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of rows whose length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / math.sqrt(n)


@lru_cache(maxsize=4096)
def _signs(width: int, table: int, level: int) -> np.ndarray:
    return np.random.default_rng([SEED, width, table, level]).choice([-1.0, 1.0], size=(3, width))


def buckets(unit: np.ndarray, table: int, depth: int, probes: int) -> np.ndarray:
    """The buckets of each row in a table: its own first, then by how much less likely they are."""
    rows, length = unit.shape
    width = 1 << max(0, (length - 1).bit_length())
    padded = np.pad(unit, ((0, 0), (0, width - length)))
    code, loss = np.zeros((rows, 1), np.int64), np.zeros((rows, 1))
    for level in range(depth):
        y = padded
        for s in _signs(width, table, level):
            y = hadamard(y * s)
        size = np.abs(y)
        top = np.argsort(-size, axis=1, kind="stable")[:, :probes]
        near = np.take_along_axis(size, top, 1)
        vertex = 2 * top + (np.take_along_axis(y, top, 1) < 0)
        code = (code[:, :, None] * (2 * width) + vertex[:, None, :]).reshape(rows, -1)
        loss = (loss[:, :, None] + ((near[:, :1] - near) ** 2)[:, None, :]).reshape(rows, -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        code, loss = np.take_along_axis(code, best, 1), np.take_along_axis(loss, best, 1)
    return code


def plan_of(length: int, classes: int, least: float = LEAST_COSINE, miss: float = MISS, probes: int = PROBES) -> tuple[int, int]:
    """(depth, tables) for vectors of a length, the largest label having so many classes."""
    width = 1 << max(0, (length - 1).bit_length())
    depth = max(1, math.ceil(math.log(max(1, classes / FILL)) / math.log(2 * width)))
    depth = min(depth, int(62 / math.log2(2 * width)))
    if length == 1:
        return depth, 1
    rng = np.random.default_rng([SEED, length])
    a = units(rng.normal(size=(4000, length)))
    side = rng.normal(size=a.shape)
    side = units(side - np.einsum("ij,ij->i", side, a)[:, None] * a)
    b = least * a + math.sqrt(1 - least * least) * side
    own, other = buckets(a, 0, depth, probes), buckets(b, 0, depth, probes)
    found = np.mean((own[:, :1] == other).any(1) | (other[:, :1] == own).any(1))
    return depth, max(1, math.ceil(math.log(miss) / math.log(1 - min(found, 0.999))))


def _signatures(plans: dict[int, tuple[int, int]], names: list[str]):
    """Adds `sig`: the buckets in all tables, PROBES or fewer of each, the own one first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[]] * batch.num_rows
            for rows, vectors in by_length(batch.column("vec")):
                depth, tables = plans[vectors.shape[1]]
                unit = units(vectors)
                found = np.concatenate([buckets(unit, t, depth, PROBES) for t in range(tables)], axis=1)
                for row, sig in zip(rows, found.tolist(), strict=True):
                    out[row] = sig
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*names, "sig"])

    return run


# ---------------------------------------------------------------- candidates and links


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the trees of each a and b, the least row as root."""

    def roots(at: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := parent[at], at):
            parent[at] = at = parent[up]
        return at

    while len(a):
        a, b = roots(a), roots(b)
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _meet(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows in one table with buckets `sig`: is a's own bucket among b's, and b's among a's?"""
    return (sig[a, :1] == sig[b]).any(1), (sig[b, :1] == sig[a]).any(1)


def bucket_links(table: int, bucket: int, split: bool, own: np.ndarray, base: np.ndarray, count: np.ndarray, vectors: np.ndarray, sig: np.ndarray, least: float):
    """Links that count in this bucket: (number for each row, parent of each row in a forest).

    Rows with `base` are in their own bucket, others probe it. With `split` only rows of different blocks `own`
    are compared. sig: (rows, tables, probes).
    """
    unit = units(vectors)
    side = own == own[0]
    left, right = (np.flatnonzero(side), np.flatnonzero(~side)) if split else (np.arange(len(own)),) * 2
    links, parent = np.zeros(len(own), np.int64), np.arange(len(own))
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        near = (unit[rows] @ unit[right].T >= least) & (base[rows][:, None] | base[right][None, :])
        i, j = np.nonzero(near)
        a, b = rows[i], right[j]
        if not split:
            a, b = a[a < b], b[a < b]
        for earlier in range(table):
            ab, ba = _meet(sig[:, earlier], a, b)
            a, b = a[~(ab | ba)], b[~(ab | ba)]
        ab, ba = _meet(sig[:, table], a, b)
        twice = ab & ba & (np.minimum(sig[a, table, 0], sig[b, table, 0]) != bucket)
        a, b = a[~twice], b[~twice]
        np.add.at(links, a, count[b])
        np.add.at(links, b, count[a])
        _merge(parent, a, b)
    return links, parent


FOUND = "id long, links long, other long"


def _compare(least: float):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
    keys = ["slot", "bucket", "i", "j"]

    def one(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        base, own = (rows.column(c).to_numpy() for c in ("base", "own"))
        split = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        if len(base) < 2 or not base.any() or split and (own == own[0]).all():
            return
        ids, count = (rows.column(c).to_numpy() for c in ("id", "n"))
        table, bucket = rows.column("slot")[0].as_py(), rows.column("bucket")[0].as_py()
        sig = matrix(rows.column("sig").combine_chunks(), np.int64)
        probes = int(rows.column("probes")[0].as_py())
        links, parent = bucket_links(table, bucket, split, own, base, count, matrix(rows.column("vec").combine_chunks()), sig.reshape(len(sig), -1, probes), least)
        parent = _ends(parent)
        hit = np.flatnonzero(links)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[parent[hit]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches arrive sorted by bucket; the bucket that a batch ends in waits for the next one."""
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            change = np.zeros(len(held), bool)
            for c in keys:
                x = held.column(c).to_numpy()
                change[1:] |= x[1:] != x[:-1]
            for c in ("label", "size"):
                x = held.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
                change[1:] |= x[1:] != x[:-1]
            cuts = [0, *np.flatnonzero(change)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield from one(held.slice(a, b - a))
            held = held.slice(cuts[-1])
        if held is not None and len(held):
            yield from one(held)

    return run


def _ends(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label and what a class is known by: 128 bits of hash of the vector; null keys link with nothing."""
    e = F.col("embedding")
    linked = finite(e) & F.exists(e, lambda x: x != 0) & F.col("label").isNotNull()
    key = [F.when(linked, F.xxhash64(F.lit(i), e)).alias(f"h{i}") for i in (0, 1)]
    return vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding", *key)


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    class_key = ["label", "h0", "h1"]
    rows = _keyed(vectors)
    linked = rows.where(F.col("h0").isNotNull())
    cells = linked.groupBy("label", F.size("embedding").alias("size")).agg(F.approx_count_distinct("h0").alias("n"))
    plans = {r["size"]: plan_of(r["size"], r["n"], least) for r in cells.groupBy("size").agg(F.max("n").alias("n")).collect()}
    probes = {size: min(PROBES, (1 << max(0, (size - 1).bit_length())) ** depth) for size, (depth, _) in plans.items()}
    with scratch(spark) as keep:
        classes = linked.groupBy(*class_key).agg(F.first("embedding").alias("vec"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"))
        names = classes.columns
        signed = classes.mapInArrow(_signatures(plans, names), with_fields(classes.schema, names, sig=T.ArrayType(T.LongType())))
        signed = materialize(signed.withColumn("id", F.monotonically_increasing_id()))
        size = F.size("vec").alias("size")
        of_size = F.create_map(*[F.lit(x) for kv in probes.items() for x in kv])[F.size("vec")] if probes else F.lit(1)
        flat = signed.select("label", size, of_size.alias("probes"), "id", F.posexplode("sig").alias("pos", "bucket"))
        by = ["label", "size", "slot", "bucket"]
        flat = flat.select("label", "size", "id", F.floor(F.col("pos") / F.col("probes")).cast("int").alias("slot"), "bucket")
        crowded = materialize(flat.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > bucket_rows))
        full = signed.select("label", size, of_size.alias("probes"), "id", "n", "vec", "sig", F.posexplode("sig").alias("pos", "bucket"))
        slot = F.floor(F.col("pos") / F.col("probes")).cast("int")
        full = full.withColumns({"slot": slot, "base": F.col("pos") % F.col("probes") == 0}).drop("pos")
        dealt = full.withColumns({"own": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
        if not crowded.isEmpty():
            blocks = F.ceil(F.col("rows") * 2 / bucket_rows).cast("int")
            own = F.pmod(F.xxhash64("id", "slot"), F.col("blocks")).cast("int")
            cut = full.join(crowded.select(*by, blocks.alias("blocks")), by)
            cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            cut = cut.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")
            dealt = dealt.join(crowded, by, "left_anti").unionByName(cut)
        order = [*by, "i", "j"]
        found = dealt.repartition(partitions, *order).sortWithinPartitions(*order).mapInArrow(_compare(least), FOUND)
        found = materialize(found)
        roots = components(found.select(F.col("id").alias("src"), F.col("other").alias("dst")))
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        known = signed.select(*class_key, "id", "n", "low").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
        known = materialize(known.select(*class_key, "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")))
        least_id = materialize(known.groupBy("root").agg(F.min("low").alias("component_id")))
        known = materialize(known.join(least_id, "root").select(*class_key, "n_links", "component_id"))
        joined = linked.select("vec_id", *class_key).join(known, class_key).select("vec_id", "n_links", "component_id")
        alone = rows.where(F.col("h0").isNull()).select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
        out = joined.unionByName(alone)
        return keep(out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


#: All pairs of a label; components by following links.
ORACLE = f"""
WITH RECURSIVE rows_of AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
         coalesce(len(embedding) > 0 AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, FALSE) AS good,
         row_number() OVER (ORDER BY vec_id) AS r
  FROM embeddings),
links AS (
  SELECT a.r AS src, b.r AS dst FROM rows_of a JOIN rows_of b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r AND a.good AND b.good
  WHERE list_cosine_similarity(a.v, b.v) >= {LEAST_COSINE}),
reach AS (
  SELECT r AS node, r AS other FROM rows_of
  UNION SELECT reach.node, links.dst FROM reach JOIN links ON links.src = reach.other),
lows AS (SELECT node, min(rows_of.vec_id) AS component_id FROM reach JOIN rows_of ON rows_of.r = reach.other GROUP BY node),
counts AS (SELECT src, count(*) AS n FROM links GROUP BY src)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows_of JOIN lows ON lows.node = r LEFT JOIN counts ON counts.src = r
"""
