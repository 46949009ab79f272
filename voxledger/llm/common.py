"""Helpers the training-data operators share: the store of tables on the way, word splitting and ranks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxledger.functions.store import materialize, remove, scratch, shared_dir, stored

__all__ = ["CHUNK_BYTES", "WORD_RE", "materialize", "packed", "ranks", "read_table", "remove", "scratch", "shared_dir", "stored", "word_count", "words_in_chunks"]

#: Spark/Java regex of a word: a maximal run of anything but ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Longest piece of a text that is split into Python words at once.
CHUNK_BYTES = 4 << 20

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> Column:
    """All columns of `docs` as one struct `row`: whatever their names, none clashes with a helper's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def words_in_chunks(data: bytes, limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """ASCII-white-space words of `data`, some at a time, so a very long text never becomes one list.

    bytes.split() cuts at exactly 0x20 and 0x09-0x0D.
    """
    if len(data) <= limit:
        yield data.split()
        return
    at, carry = 0, b""
    while at < len(data):
        piece = carry + data[at : at + limit]
        at += limit
        if at < len(data):
            stripped = piece.rstrip(b"\t\n\x0b\x0c\r ")
            if len(stripped) == len(piece):  # the last word may go on in the next piece
                cut = max(piece.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                carry, piece = piece[cut + 1 :], piece[: cut + 1]
            else:
                carry = b""
        yield piece.split()


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def ranks(df: DataFrame, group: list[str], bucket: list[str], order: list[Column], name: str) -> DataFrame:
    """`df` with `name`: the 1-based row number within `group`, without bringing a group into one task.

    `bucket` columns must sort before `order` does: rows of a lower bucket precede all of a higher one.
    `group` and `bucket` columns must not be null, so that the join below keeps the window's partitioning.
    Rows are numbered inside each (group, bucket) and shifted by the sizes of the buckets before it.
    The table of bucket sizes is aggregated before it is shuffled; the rows themselves are shuffled once.
    `df` has no columns `__n`, `__row` or `__before`.
    """
    keys = group + bucket
    before = W.partitionBy(*group).orderBy(*bucket).rowsBetween(W.unboundedPreceding, -1)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = df.withColumn("__row", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return local.join(sizes, keys).withColumn(name, (F.col("__row") + F.col("__before")).cast("long")).drop("__row", "__before")
