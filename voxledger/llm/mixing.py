"""Operator 5: mixing sources to target weights by systematic sampling.

A document's size is its number of words. Sources take weights WEIGHTS in turn, by code point with null
last, and share the total of all sizes; a target stops at CAP times its source's size and the excess is
shared again by weight. Each document's expected copies are target / source size. Within a source,
documents stand in a fixed order, the prefix sums of expected copies get one offset, and a document is emitted
once for each integer that its interval crosses, so a source's taken words stay near its target and no document
is emitted more than CAP times. The order is by size class, then by a hash of doc_id and text: neighbours have
like sizes, which keeps the taken words near the target even if few documents hold most words. Of OFFSETS evenly
spaced offsets, the first of them pseudo-random, a source gets the one whose taken words come nearest its target
(of equals the first). What is still lacking is a few times the largest document at most: where one document outweighs
a source's target, as in very small tables, no offset hits it. Offset and order depend on `seed` and the source's own rows and
target alone, so reruns agree however the rows are dealt; rows equal in doc_id and text are copies of each other,
and any of them may be taken.

Prefix sums are counts: equal rows are counted by the part of the table that they are in, these counts are summed up
within (source, class, hash slot) and shifted by the sizes of the slots before, so neither a source nor a group of equal
rows with a third of all rows ever meets in one task. There are as many slots as rows need, about SLOT_ROWS rows each; the
order doesn't depend on their number. Rows are stored first, so that a row is in the same part whenever it is read.

Null texts have size 0 and, like empty ones, are emitted by the same rule. Null sources are one source, null
ids are told apart by their texts. If all sizes are 0 every target is 0. Repeated rows are sampled one by one.
An empty table gives an empty one. Other columns, whatever their names, stay in the struct `row`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxledger.functions.prefix import running_sum

from .common import materialize, packed, ranks, read_table, scratch, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: How many offsets are tried for a source: a power of two, so that all are exact.
OFFSETS = 64
#: About how many rows of one source and size class are ordered in one task.
SLOT_ROWS = 100_000


def _class(size: Column) -> Column:
    """Order-preserving size class: bit length and the three bits after the first (about 9 % wide)."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.floor(size * 8 / F.pow(F.lit(2.0), bits - 1)) % 8).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """__source, __source_size, __target for rows of (__source, __size)."""
    per = materialize(sizes.groupBy("__source").agg(F.sum("__size").alias("__source_size")))
    per = per.withColumns({"__null": F.col("__source").isNull().cast("int"), "__first": F.coalesce(F.substring("__source", 1, 1), F.lit(""))})
    per = ranks(per, [], ["__null", "__first"], [F.col("__source").asc_nulls_last()], "__rank").drop("__null", "__first")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("__rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    per = materialize(per.withColumn("__w", weight.cast("long")))
    total = per.agg(F.sum("__source_size")).first()[0] or 0
    # The level rises until no more sources reach their caps: a few sums over the table of sources.
    level, weights, capped_size = 0.0, per.agg(F.sum("__w")).first()[0] or 0, 0
    while weights:
        level = float(total - CAP * capped_size) / float(weights)
        full = CAP * F.col("__source_size") <= F.lit(level) * F.col("__w")
        row = per.agg(F.sum(F.when(full, F.col("__source_size"))), F.sum(F.when(~full, F.col("__w")))).first()
        if (row[0] or 0, row[1] or 0) == (capped_size, weights):
            break
        capped_size, weights = row[0] or 0, row[1] or 0
    target = F.least((CAP * F.col("__source_size")).cast("double"), F.lit(level) * F.col("__w")) if weights else (CAP * F.col("__source_size")).cast("double")
    return per.select("__source", "__source_size", target.alias("__target"))


def sized(docs: DataFrame, *keep: Column) -> DataFrame:
    """`keep`, source, __size, __digest and the part of the table of each row: all that the mix needs of a text."""
    digest = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return docs.select(*keep, F.col("source").alias("__source"), word_count(F.col("text")).alias("__size"), digest.alias("__digest"), F.spark_partition_id().alias("__part"))


def _dealt(rows: DataFrame, slots: int) -> DataFrame:
    """Rows of sized() with the bucket that each is ordered in."""
    slot = F.floor(F.conv(F.substring("__digest", 1, 8), 16, 10).cast("long") * F.lit(slots) / F.lit(2.0**32)).cast("long")
    group = F.coalesce(F.concat(F.lit("="), "__source"), F.lit("null"))
    return rows.withColumns({"__group": group, "__class": _class(F.col("__size")), "__slot": slot})


def _offsets(starts: DataFrame) -> DataFrame:
    """__group and __offset: the one of OFFSETS whose taken words come nearest the target. Equal rows (__n of them after
    __before others, __size words together) are taken as often as integers lie in their common interval."""
    reached = lambda k: F.floor(k * F.col("__each") + F.col("__u"))
    times = reached(F.col("__before") + F.col("__n")) - reached(F.col("__before"))
    tried = starts.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1)))).withColumn("__u", (F.col("__first") + F.col("__i") / OFFSETS) % 1)
    # summed up where the rows are: a row for each source and offset is shuffled
    sums = tried.groupBy("__group", "__target", "__i", "__u").agg(F.sum(times * (F.col("__size") / F.col("__n")).cast("long")).cast("double").alias("__taken"))
    return sums.groupBy("__group").agg(F.min_by("__u", F.struct(F.abs(F.col("__taken") - F.col("__target")), "__i")).alias("__offset"))


def _numbered(rows: DataFrame, seed: str, slots: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored rows of sized() with __source_size, __target and __copies. They are read twice: once for the sizes of
    buckets, once to be numbered, which is the one shuffle of what they hold. keep() stores what the result rests on."""
    dealt = _dealt(rows, slots)
    # Rows equal in all that the order knows are counted, by the part of the table that they are in: of a bucket only these
    # counts meet in a task, and rows are numbered within such counts.
    equal = ["__group", "__digest", "__part"]
    counts = dealt.groupBy("__source", *equal, "__class", "__slot").agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__size"))
    counts = materialize(counts)
    plan = targets(counts.select("__source", "__size"))
    plan = plan.withColumn("__group", F.coalesce(F.concat(F.lit("="), "__source"), F.lit("null")))
    first = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("__source"), F.lit("")))), 1, 4), 16, 10).cast("double") / 65536
    each = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    plan = materialize(plan.select("__group", "__source_size", "__target", first.alias("__first"), each.alias("__each")))
    upto = running_sum(counts, ["__group"], ["__class", "__slot"], [F.col("__digest"), F.col("__part")], "__n", "__upto")
    starts = materialize(upto.select(*equal, "__n", "__size", (F.col("__upto") - F.col("__n")).alias("__before")).join(plan, "__group"))
    starts = starts.drop("__n", "__size", "__first").join(materialize(_offsets(starts)), "__group")
    row = F.row_number().over(W.partitionBy(*equal).orderBy(F.lit(1)))
    copies = lambda k: F.floor(k * F.col("__each") + F.col("__offset"))
    k = F.col("__row") + F.col("__before")
    placed = dealt.drop("__class", "__slot").join(keep(starts), equal).withColumn("__row", row)
    return placed.withColumn("__copies", (copies(k) - copies(k - 1)).cast("long")).drop(*equal, "__row", "__before", "__each", "__offset", "__source")


def _slots(docs: DataFrame) -> int:
    """A power of two, at least 16, that leaves about SLOT_ROWS rows to a slot."""
    return 1 << max(4, math.ceil(math.log2(max(1, docs.count()) / SLOT_ROWS)))


def mix(docs: DataFrame, seed: str = SEED, slots: int | None = None) -> DataFrame:
    """row (the columns of docs), size, source_size, target and copies of every row of docs."""
    with scratch(docs.sparkSession) as keep:
        rows = keep(sized(docs, packed(docs)))  # so that the parts are the same in both reads
        found = _numbered(rows, seed, slots or _slots(rows), keep)
    return found.select("row", *[F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "copies")])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    with scratch(spark) as keep:
        rows = materialize(sized(docs, F.col("doc_id")))  # texts are read once, and never shuffled
        found = _numbered(rows, SEED, _slots(rows), materialize)
        return keep(found.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken")))


def emit(docs: DataFrame) -> DataFrame:
    """Pipeline stage: each row once for each copy, columns unchanged. Texts are stored once, with their sizes, and
    shuffled once."""
    mixed = mix(docs).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE = r"""
WITH s AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS digest, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM s GROUP BY source),
o AS (
  SELECT *, 3.0 * source_size / w AS r,
         CAST(sum(source_size) OVER (ORDER BY 1.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS size_before,
         CAST(sum(w) OVER (ORDER BY 1.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS w_left,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM per),
lev AS (SELECT (total - 3 * coalesce(size_before, 0)) / w_left AS level FROM o WHERE (total - 3 * coalesce(size_before, 0)) / w_left < r ORDER BY r, source LIMIT 1),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), coalesce((SELECT level FROM lev) * w, 3 * source_size)) AS target FROM per),
k AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
         CAST(CAST('0x' || substr(md5('mix-1/' || coalesce(s.source, '')), 1, 4) AS BIGINT) AS DOUBLE) / 65536 AS u,
         row_number() OVER (PARTITION BY s.source ORDER BY
           length(bin(size)) * 8 + ((size * 8) // CAST(pow(2, length(bin(size)) - 1) AS BIGINT)) % 8,
           digest) AS i
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
tried AS (SELECT source, j, (u + j / 64.0::DOUBLE) % 1 AS v, abs(CAST(sum(CAST(floor(i * e + (u + j / 64.0::DOUBLE) % 1) - floor((i - 1) * e + (u + j / 64.0::DOUBLE) % 1) AS BIGINT) * size) AS DOUBLE) - target) AS error
  FROM k, range(64) AS r(j) GROUP BY source, j, u, target),
best AS (SELECT source, arg_min(v, (error, j)) AS v FROM tried GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(floor(i * e + v) - floor((i - 1) * e + v) AS BIGINT) * size AS taken
FROM k JOIN best ON k.source IS NOT DISTINCT FROM best.source
"""
