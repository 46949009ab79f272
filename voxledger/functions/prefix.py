"""Scans within groups of any size: running sums, last values, rows before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return out


def _carried_in(df: DataFrame, group: list[str], bucket: list[str], carries: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """Rows with what the buckets before theirs carry in: `carries` are aggregates of a bucket, `over` is what all
    buckets before one make of them. A row for each bucket is all that meets in a group."""
    keys = group + bucket
    each = df.groupBy(*keys).agg(*[c.alias(n) for n, c in carries.items()])
    before = W.partitionBy(*group).orderBy(*[F.col(b).asc_nulls_first() for b in bucket]).rowsBetween(W.unboundedPreceding, -1)
    shift = each.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c.over(before).alias(n) for n, c in over.items()])
    return df.join(shift, _same(keys)).drop(*[f"__k{i}" for i in range(len(keys))])


def running_sums(df: DataFrame, group: list[str], bucket: list[str], order: list[Column], sizes: dict[str, str]) -> DataFrame:
    """`df` with each name of `sizes`: the sum of its column up to and with each row of its group.

    Rows are summed inside (group, bucket), then shifted by the sums of the group's lower buckets, so only a
    bucket needs to fit a task. All rows of a lower bucket must precede those of a higher one.
    """
    own = W.partitionBy(*group, *bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = df.withColumns({f"__own_{n}": F.sum(size).over(own) for n, size in sizes.items()})
    carries = {f"__sum_{n}": F.sum(size) for n, size in sizes.items()}
    shifted = _carried_in(summed, group, bucket, carries, {f"__before_{n}": F.sum(f"__sum_{n}") for n in sizes})
    out = shifted.withColumns({n: F.col(f"__own_{n}") + F.coalesce(f"__before_{n}", F.lit(0)) for n in sizes})
    return out.drop(*[f"__{k}_{n}" for n in sizes for k in ("own", "before")])


def running_sum(df: DataFrame, group: list[str], bucket: list[str], order: list[Column], size: str, name: str) -> DataFrame:
    """One running sum."""
    return running_sums(df, group, bucket, order, {name: size})


def last_so_far(df: DataFrame, group: list[str], bucket: list[str], order: list[str], value: Column, name: str, own_row: bool = True) -> DataFrame:
    """`df` with `name`: the last value that isn't null up to each row of its group, with or without the row itself.

    The same scan in buckets as running_sums(), for another operator: "the later of two, if it says anything".
    """
    place = [F.col(c) for c in order]
    upto = W.partitionBy(*group, *bucket).orderBy(*place).rowsBetween(W.unboundedPreceding, 0 if own_row else -1)
    valued = df.withColumn("__value", value).withColumn("__own", F.last("__value", ignorenulls=True).over(upto))
    last = F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*place)))
    shifted = _carried_in(valued, group, bucket, {"__last": last}, {"__before": F.last("__last", ignorenulls=True)})
    return shifted.withColumn(name, F.coalesce("__own", "__before")).drop("__value", "__own", "__before")


def previous(df: DataFrame, group: list[str], bucket: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`df` with `name`: the value of the row before, null or not; null in the first row of a group."""
    told = last_so_far(df, group, bucket, order, F.struct(F.col(value).alias("v")), "__told", own_row=False)
    return told.withColumn(name, F.col("__told.v")).drop("__told")
