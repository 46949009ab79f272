"""Multi-line blocks: which application's header starts an entry, and which lines continue it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxledger.functions.steps import once
from voxledger.operators.headers import CONTINUATION, start_kind, with_start_kind

__all__ = ["CONTINUATION", "blocks", "entry_id", "start_kind", "with_start_kind"]



def entry_id(file_token: Column, read_order: Column) -> Column:
    """The name of a file's entry."""
    return F.concat(F.lit("ARQUIVO_"), F.regexp_extract(file_token, r"(\d+)", 1), F.lit("_ENTRADA_"), read_order.cast("string"))


def blocks(lines: DataFrame, bucket_lines: int = 100_000) -> DataFrame:
    """Blocks of lines (file_token, app, line_no, start_byte, end_byte, text, terminator, start_kind).

    A header closes the open block and opens another; a continuation joins the open block, and before the
    first header each is an orphan block of its own. read_order counts blocks from 0 within a file. Headers and
    orphans are counted in buckets of lines, so a file of any size is never one task.
    """
    keys = ["__file", "__bucket"]
    marked = lines.withColumns({"__file": F.coalesce("file_token", F.lit("")), "__bucket": F.floor(F.col("line_no") / bucket_lines), "__header": (F.col("start_kind") != CONTINUATION).cast("long")})
    upto = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    counted = marked.withColumns({"__headers": F.sum("__header").over(upto), "__lines": F.count(F.lit(1)).over(upto)})
    # a row for each bucket; only numbers are read for it
    each = counted.groupBy(*keys).agg(F.max("__headers").alias("own"), F.count_if(F.col("__headers") == 0).alias("lead"))
    order = W.partitionBy("__file").orderBy("__bucket")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    each = each.withColumn("__headers_before", zero(F.sum("own").over(before))).withColumn("orphans", F.when(F.col("__headers_before") == 0, F.col("lead")).otherwise(0))
    each = each.withColumns({"__orphans_before": zero(F.sum("orphans").over(before)), "__orphans": F.sum("orphans").over(order.rowsBetween(W.unboundedPreceding, 0))})
    # each line before a file's first header is an orphan; after these, each header opens a block
    headers = F.col("__headers_before") + F.col("__headers")
    number = F.when(headers == 0, F.col("__orphans_before") + F.col("__lines")).otherwise(F.col("__orphans") + headers) - 1
    placed = counted.join(each.drop("own", "lead", "orphans"), keys).withColumn("read_order", number)
    return joined(placed)


@once
def _joining() -> tuple[list[Column], list[Column]]:
    line = F.struct("line_no", "text", "terminator")
    text = F.concat_ws("", F.flatten(F.transform("lines", lambda x: F.array(x["text"], x["terminator"]))))
    return [
        F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"),
        F.min_by("start_kind", "line_no").alias("start_kind"), F.bool_and(F.col("text").isNotNull()).alias("decodable"), F.sort_array(F.collect_list(line)).alias("lines"),
    ], [entry_id(F.col("file_token"), F.col("read_order")).alias("entry_id"), F.when(F.col("decodable"), text).alias("text")]


def joined(placed: DataFrame) -> DataFrame:
    """Blocks of lines whose read_order is known."""
    lines, (name, text) = _joining()
    each = placed.groupBy("file_token", "app", "read_order").agg(*lines)
    return each.select("file_token", "app", name, "read_order", "line_start", "line_end", "start_byte", "end_byte", "start_kind", text)
