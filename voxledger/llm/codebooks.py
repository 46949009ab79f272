"""Operator 13: vector codes (product quantisation) with exponion search and exact integers.

Components become integers floor(1024 * x); vectors are cut into PARTS equal parts, each with a codebook of at most
ENTRIES entries, fitted by Lloyd rounds over all vectors. Search of a part: start at the entry that it had before,
at squared distance U. By the triangle inequality every entry as near as that lies within twice the distance of the
start, so its squared distance from the start is 4 U or less: the start's list of entries, sorted by distance, is scanned up to that radius
and no further. Distances are exact integers and of equal ones the lower index wins, so the result is that of a scan
of all entries.

Rows with their codes are stored for each round, so that the next one starts there; the round before is
removed. A task adds up the parts of each entry; sums are added in Spark, and only codebooks (ENTRIES * dimension
integers) come to the driver and go back.

Rows whose vector is null, empty, has null or non-finite components, or isn't of the length that most vectors have
(of equal ones the greatest) are dropped. A length that PARTS doesn't divide is filled up with zeros. Fewer vectors than entries give a smaller codebook.
Repeated rows and vec_ids are rows of their own; of equal vec_ids the smaller vector comes first in the codebook, null
vec_ids come last. Components are exact up to +-2^24; larger ones raise an error. Other columns are left alone. An empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, remove, scratch, shared_dir, stored
from .vectors import common_length, finite, lists, matrix, with_fields

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Largest integer component: sums of squares stay exact in double precision for up to 8 dimensions a part; wider
#: parts use whole numbers.
LARGEST = 1 << 24


def integers(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """(vec_id, label and q of the rows that count, length of q; 0 without rows)."""
    good = vectors.where(finite(F.col("embedding"))).select("vec_id", "label", "embedding")
    length = common_length(good, "embedding") or 0

    def entry(c):
        y = F.floor(c.cast("double") * SCALE)
        return F.when(F.abs(y) <= LARGEST, y.cast("int")).otherwise(F.raise_error(F.lit("a vector component is too large to be coded")).cast("int"))

    padding = F.array_repeat(F.lit(0), -length % parts)
    q = F.concat(F.transform("embedding", entry), padding)
    return good.where(F.size("embedding") == length).select("vec_id", "label", q.alias("q")), length + -length % parts


# ---------------------------------------------------------------- search


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of `a` from all rows of `b` (integers)."""
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * top * top * a.shape[1] < 1 << 53:  # every term and sum is a whole number that a double holds
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        out += (a[:, k, None].astype(np.int64) - b[None, :, k]) ** 2
    return out


class Codebook:
    """The entries of one part, and for each entry all entries sorted by distance, then index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = squared(entries, entries)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.radius = np.take_along_axis(between, self.order, 1)

    def nearest(self, points: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry, found from the entries `start`."""
        best, least = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
        by_start = np.argsort(start, kind="stable")
        cuts = np.flatnonzero(np.diff(start[by_start], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(points)], strict=True):
            rows = by_start[a:b]
            s = int(start[rows[0]])
            own = squared(points[rows], self.entries[s : s + 1])[:, 0]
            reach = np.searchsorted(self.radius[s], 4 * own, side="right")
            # points of like reach are compared together: none scans over twice its own list
            level = np.ceil(np.log2(reach)).astype(int)
            for k in np.unique(level):
                some = rows[level == k]
                near = self.order[s, : int(reach[level == k].max())]
                distance = squared(points[some], self.entries[near])
                low = distance.min(axis=1)
                least[some] = low
                best[some] = np.where(distance == low[:, None], near[None, :], len(self.entries)).min(axis=1)
        return best, least


# ---------------------------------------------------------------- rounds


def _assign(books, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(entries) for entries in books.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = np.split(matrix(batch.column("q"), np.int64), len(own), axis=1)
            before = matrix(batch.column("code"), np.int64) if "code" in batch.schema.names else np.zeros((batch.num_rows, len(own)), np.int64)
            found = [book.nearest(part, before[:, k]) for k, (book, part) in enumerate(zip(own, parts, strict=True))]
            code = lists(np.stack([b for b, _ in found], axis=1).astype(np.int16), pa.int16())
            error = pa.array(sum(d for _, d in found), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), code, error], names=[*names, "code", "error"])

    return run


def assigned(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """rows (vec_id, label, q, perhaps code) with `code` and `error` by these codebooks."""
    names = ["vec_id", "label", "q"]
    schema = with_fields(rows.schema, names, code=T.ArrayType(T.ShortType()), error=T.LongType())
    # ENTRIES * length integers
    return rows.mapInArrow(_assign(rows.sparkSession.sparkContext.broadcast(books), names), schema)


def _part_sums(entries: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            q, code = matrix(batch.column("q"), np.int64), matrix(batch.column("code"), np.int64)
            width = q.shape[1] // parts
            total = np.zeros((parts, entries, width), np.int64) if total is None else total
            for p in range(parts):
                np.add.at(total[p], code[:, p], q[:, p * width : (p + 1) * width])
                count[p] += np.bincount(code[:, p], minlength=entries)
        if total is not None:
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), lists(total[p, e], pa.int64())], names=["part", "entry", "n", "total"])

    return run


def moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks whose entries are the floors of the means of their parts; unused entries stay."""
    width = books[0].shape[1]
    parts = rows.select("q", "code").mapInArrow(_part_sums(len(books[0]), len(books)), "part int, entry int, n long, total array<long>")
    sums = parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)])
    out = [b.copy() for b in books]
    for r in sums.collect():
        out[r["part"]][r["entry"]] = [r[f"t{k}"] // r["n"] for k in range(width)]
    return out


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    return np.split(np.array([r["q"] for r in first], np.int64), parts, axis=1)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code as an array and error of every row that counts; the final codebooks). The rows are stored
    below spark.checkpoint.dir."""
    spark = vectors.sparkSession
    rows, length = integers(vectors, parts)
    if not length:
        return rows.select("vec_id", "label", F.array().cast("array<smallint>").alias("code"), F.lit(0).cast("long").alias("error")), []
    books, before = first_books(rows, parts, entries), None
    for left in range(rounds, -1, -1):
        path = shared_dir(spark)
        rows = stored(assigned(rows, books) if left else assigned(rows, books).drop("q"), path)
        if before:
            remove(spark, before)
        before = path
        if left:
            books = moved(rows, books)
    return rows, books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = encode(read_table(spark, sf_dir, "embeddings"))
    digits = [F.lpad(F.hex(F.get("code", F.lit(k)).cast("long")), 2, "0") for k in range(PARTS)]
    with scratch(spark) as keep:
        totals = keep(rows.groupBy("label").agg(F.sum("error").alias("label_error")))
    # its files' size tells Spark whether the table of labels may be broadcast; else rows are joined by label, which
    # adaptive execution splits where a label is large
    totals = totals.withColumnRenamed("label", "of")
    joined = rows.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.concat(*digits)).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """All entries are scanned, in whole numbers that doubles hold: a round is an assignment and new codebooks."""
    steps = [
        """WITH good AS (
  SELECT vec_id, label, embedding AS e FROM embeddings
  WHERE coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0, FALSE)),
kept AS MATERIALIZED (
  SELECT vec_id, label, q, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS r, len(q) // 4 AS w
  FROM (SELECT vec_id, label, list_transform(e, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM good
        WHERE len(e) = (SELECT len(e) FROM good GROUP BY len(e) ORDER BY count(*) DESC, len(e) DESC LIMIT 1))),
parts AS MATERIALIZED (
  SELECT r, p, q[p * w + 1 : (p + 1) * w] AS v FROM kept, (SELECT unnest([0, 1, 2, 3]) AS p)),
b0 AS MATERIALIZED (SELECT p, r AS entry, v FROM parts WHERE r < 256)"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""n{k} AS MATERIALIZED (
  SELECT r, p, CAST(m // 256 AS BIGINT) AS d, m % 256 AS entry FROM (
    SELECT a.r, a.p, min(CAST(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v) AS BIGINT) * 256 + b.entry) AS m
    FROM parts a JOIN b{k} b ON a.p = b.p GROUP BY a.r, a.p))""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (
  SELECT p, entry, list(x ORDER BY pos) AS v FROM (
    SELECT p, entry, pos, floor(sum(x) / count(*)) AS x FROM (
      SELECT n.p, n.entry, unnest(a.v) AS x, generate_subscripts(a.v, 1) AS pos FROM n{k} n JOIN parts a ON a.r = n.r AND a.p = n.p)
    GROUP BY p, entry, pos) GROUP BY p, entry),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.entry = b.entry)""")
    steps.append(f"""flat AS (SELECT string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, entry, pos) AS s FROM (
  SELECT p, entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM b{ROUNDS})),
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha256(s) AS codebooks_sha256
FROM kept JOIN coded USING (r), flat""")
    return ",\n".join(steps)


ORACLE = _oracle()
