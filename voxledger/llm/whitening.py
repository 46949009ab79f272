"""Operator 12: whitening of vectors by a tiled covariance.

Entries become integers x = floor(64 * c) + 1000000. A first pass adds up each dimension. Then rows are cut into row
blocks and each row block into column blocks of `tile` dimensions, stored in the narrowest number type that holds
them. A pair of tiles is a key: column blocks are shuffled to the pairs that they take part in, row block by row
block, the pair of blocks is multiplied, and products are added for each tile: first in the task, then over slots of
row blocks, at last entry by entry. The driver assembles the d x d covariance, takes its eigenvectors and
sends them back; d is at most MAX_DIMENSION, so both are bounded. Where all dimensions fit one tile, blocks have no
partner to meet and are multiplied where they are.

Sums are exact. Before multiplying, entries are centred: the integer part of the mean is taken off exactly, the
fraction in double precision.

Rows whose vector is null, empty, has null or non-finite entries, or isn't of the length that most vectors
have (of equal ones the greatest) are dropped. Repeated rows and repeated or null vec_ids are rows of their own. A component whose variance is
zero, up to rounding (as of dimensions that never change), has `whitened` 0 and doesn't count in identity_error.
Entries beyond +-2^31 / 64 raise an error, and so does a deviation beyond a long. Other columns are left alone. An
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .vectors import common_length, finite, lists, matrix

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Dimensions of a tile.
TILE = 32
#: Rows of a row block; the largest block of doubles is ROWS * TILE * 8 bytes.
ROWS = 4096
#: The driver and each task hold a matrix of so many rows and columns at most (512 MB).
MAX_DIMENSION = 8192


def scaled(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id and x of the rows that count, their dimension; 0 without rows)."""
    good = vectors.where(finite(F.col("embedding"))).select("vec_id", "embedding")
    length = common_length(good, "embedding") or 0
    if length > MAX_DIMENSION:
        raise ValueError(f"vectors of {length} dimensions; at most {MAX_DIMENSION} can be whitened")

    def entry(c):
        y = F.floor(c.cast("double") * SCALE)
        return F.when(F.abs(y) < 2**31, y.cast("long") + SHIFT).otherwise(F.raise_error(F.lit("a vector entry is too large to be scaled")).cast("long"))

    return good.where(F.size("embedding") == length).select("vec_id", F.transform("embedding", entry).alias("x")), length


# ---------------------------------------------------------------- sums and tiles


def _column_sums(name: str):
    schema = pa.schema([("dim", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                own = matrix(batch.column(name), np.int64).sum(axis=0)
                total, n = own if total is None else total + own, n + batch.num_rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array(np.full(len(total), n))], schema=schema)

    return run


def column_sums(rows: DataFrame, name: str) -> tuple[int, np.ndarray]:
    """(number of rows, exact sum of each dimension) of a column of integer vectors."""
    parts = rows.select(name).mapInArrow(_column_sums(name), "dim int, total long, n long")
    sums = parts.groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("dim").collect()
    return (sums[0]["n"], np.array([r["total"] for r in sums])) if sums else (0, np.zeros(0, np.int64))


def _narrow(block: np.ndarray) -> np.ndarray:
    """The block in the narrowest type that holds it."""
    if block.dtype.kind == "f":
        return block
    low, high = (int(block.min()), int(block.max())) if block.size else (0, 0)
    return block.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


BLOCK = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("slot", pa.int32()), ("block", pa.int64()), ("side", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])


def _row_blocks(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            kind = np.int64 if pa.types.is_integer(batch.column(name).type.value_type) else np.float64
            yield matrix(batch.column(name).slice(at, ROWS), kind)


def _column_blocks(name: str, whole: np.ndarray, tile: int, slots: int):
    """Column blocks of each row block, once for each tile pair that they take part in."""
    tiles = -(-len(whole) // tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, rows in enumerate(_row_blocks(batches, name)):
            block, out = (part << 32) + k, []
            for t in range(tiles):
                data = _narrow(rows[:, t * tile : (t + 1) * tile] - whole[t * tile : (t + 1) * tile])
                kind, raw = data.dtype.str, np.ascontiguousarray(data).tobytes()
                out += [(min(t, u), max(t, u), (part + k) % slots, block, int(t > u), kind, raw) for u in range(tiles)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), BLOCK, strict=True)], schema=BLOCK)

    return run


def _entries(i: int, j: int, product: np.ndarray, tile: int) -> pa.RecordBatch:
    """A tile's sum: a row for each of its dimensions on the left."""
    a = np.arange(len(product)) + i * tile
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(np.full(len(a), j * tile), pa.int32()), lists(product, pa.float64())], names=["a", "first", "products"])


PRODUCTS = "a int, first int, products array<double>"


def _multiply(rest: np.ndarray, tile: int):
    """Sums of the products of block pairs. Rows arrive sorted by tile pair, row block and side; a diagonal tile
    has one block, others two."""

    def part(t: int, kind: str, raw: bytes) -> np.ndarray:
        own = rest[t * tile : (t + 1) * tile]
        return np.frombuffer(raw, kind).reshape(-1, len(own)) - own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, left = None, None, None
        for batch in batches:
            for i, j, _, block, side, kind, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (i, j):
                    if at is not None:
                        yield _entries(*at, total, tile)
                    at, total = (i, j), 0.0
                if i == j:
                    y = part(i, kind, raw)
                    total = total + y.T @ y
                elif side == 0:
                    left = block, part(i, kind, raw)
                else:
                    if left is None or left[0] != block:
                        raise ValueError("a row block came without its partner")
                    total = total + left[1].T @ part(j, kind, raw)
        if at is not None:
            yield _entries(*at, total, tile)

    return run


def _one_tile(name: str, whole: np.ndarray, rest: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in _row_blocks(batches, name):
            if len(rows):
                y = (rows - whole) - rest
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield _entries(0, 0, total, len(whole))

    return run


def covariance(rows: DataFrame, name: str, n: int, whole: np.ndarray, rest: np.ndarray, tile: int = TILE) -> np.ndarray:
    """The covariance (divisor n) of a column of vectors whose mean is whole + rest, whole being of the vectors' type.

    `rows` must be the same in every attempt of a task, as a table that is read is.
    """
    d = len(whole)
    if d <= tile:
        products = rows.select(name).mapInArrow(_one_tile(name, whole, rest), PRODUCTS)
    else:
        spark, pairs = rows.sparkSession, -(-d // tile) * (-(-d // tile) + 1) // 2
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        blocks = rows.select(name).mapInArrow(_column_blocks(name, whole, tile, -(-partitions // pairs)), "i int, j int, slot int, block long, side int, kind string, data binary")
        met = blocks.repartition(partitions, "i", "j", "slot").sortWithinPartitions("i", "j", "slot", "block", "side")
        products = met.mapInArrow(_multiply(rest, tile), PRODUCTS)
    entries = products.select("a", "first", F.posexplode("products").alias("k", "value"))
    sums = entries.groupBy("a", (F.col("first") + F.col("k")).alias("b")).agg(F.sum("value").alias("value"))
    lines = sums.groupBy("a").agg(F.collect_list(F.struct("b", "value")).alias("line"))
    out = np.zeros((d, d))
    for line in lines.toLocalIterator():
        for b, value in line["line"]:
            out[line["a"], b] = out[b, line["a"]] = value / n
    return out


# ---------------------------------------------------------------- whitening


@dataclass
class Fit:
    """What was learnt from the fit list: its size, exact sums, covariance, and the leading components."""

    n: int
    sums: np.ndarray
    covariance: np.ndarray
    values: np.ndarray  # variances of the components kept, falling
    vectors: np.ndarray  # their unit vectors, a column each

    @property
    def whole(self) -> np.ndarray:
        return self.sums // self.n

    @property
    def rest(self) -> np.ndarray:
        return (self.sums - self.whole * self.n) / self.n

    @property
    def flat(self) -> np.ndarray:
        """Which of the components have no variance but rounding."""
        return self.values <= len(self.sums) * np.finfo(float).eps * max(float(self.values[0]), 1e-300)


def fit(rows: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> Fit | None:
    """Mean, covariance and components of rows (x); None without rows."""
    n, sums = column_sums(rows, "x")
    if not n:
        return None
    found = Fit(n, sums, np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    found.covariance = covariance(rows, "x", n, found.whole, found.rest, tile)
    values, vectors = np.linalg.eigh(found.covariance)
    order = np.argsort(-values, kind="stable")[:components]
    found.values, found.vectors = np.maximum(values[order], 0.0), vectors[:, order]
    return found


def _squares(v: np.ndarray) -> np.ndarray:
    """Exact sum of squares of each row."""
    if v.size and float(np.abs(v).max()) ** 2 * v.shape[1] >= 2.0**62:
        v = v.astype(object)
    return (v * v).sum(axis=1)


def _project(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        turn = np.where(m.flat, 0.0, m.vectors / np.sqrt(np.where(m.flat, 1.0, m.values)))
        short = m.sums - m.whole * m.n
        for batch in batches:
            y = matrix(batch.column("x"), np.int64) - m.whole if batch.num_rows else np.zeros((0, len(m.sums)), np.int64)
            wide = y.astype(object) if y.size and float(np.abs(y).max() + 1) * m.n >= 2.0**62 else y
            deviation = pa.array([int(v) for v in _squares(wide * m.n - short)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists((y - m.rest) @ turn, pa.float64())], names=["vec_id", "deviation", "whitened"])

    return run


def projected(rows: DataFrame, found: Fit) -> DataFrame:
    """vec_id, deviation and whitened (an entry for each component) of every row."""
    model = rows.sparkSession.sparkContext.broadcast(found)  # 8 * d * (d + COMPONENTS) bytes, d bounded
    return rows.mapInArrow(_project(model), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, found: Fit, tile: int = TILE) -> float:
    """The largest absolute entry of the covariance of what was whitened, less the identity."""
    live = ~found.flat
    if not live.any():
        return 0.0
    zero = np.zeros(len(found.values))
    left = covariance(projected(rows, found), "whitened", found.n, zero, zero, tile) - np.eye(len(zero))
    return float(np.abs(left[np.ix_(live, live)]).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, _ = scaled(vectors)
    found = fit(rows, components, tile)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    trace = float(np.trace(found.covariance)) or 1.0
    explained = F.array(*[F.lit(float(v) / trace) for v in found.values])
    each = projected(rows, found).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(identity_error(rows, found, tile)).alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
