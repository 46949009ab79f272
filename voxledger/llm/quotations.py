"""Operator 7: chat formatting by quotation linking.

A line's quote level is the number of leading '>' marks. Passages are lines without their marks, and runs of two or
more lines of one level between blank lines, joined: so a paragraph that was wrapped anew in the quote is still
found. A passage is lower-cased, with all but letters and digits turned to single spaces, and hashed if anything is
left. Each quoted passage is joined by its hash to the message that wrote it first (at level 0): in the same
conversation, at an earlier turn. A message replies to the latest turn that its outermost linked quotes come
from; passages under MIN_WORDS words and MIN_CHARS characters, which many messages share by chance, decide only
where no longer one is linked. A thread's root is the end of its chain of replies; a conversation is ordered by
root, then turn, so replies follow what they answer, and a conversation without quotes keeps its turns. Texts come
out without quotes and without the attribution lines before them ("... wrote:").

First writers are aggregated before they are joined, so a passage that thousands of messages share has one
row for each conversation, and roots are found by pointer jumping over linked messages alone. Positions are prefix
sums over ranges of (conversation, root, turn, hash) that Spark deals evenly: neither a conversation nor a thread nor
a conversation's messages without a turn have to fit a task. Texts are shuffled once, when they get their positions.

Null and empty texts are messages without passages. Null turns come first, null conversations are one. Rows
that repeat a (conversation, turn) are kept, each with its own text; links go to the turn. Equal rows take
neighbouring positions. A text of any length is one array of lines. An empty table gives no rows. Other columns,
whatever their names, stay in the struct `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxledger.functions.prefix import running_sum

from .common import materialize, packed, read_table, scratch

MIN_WORDS, MIN_CHARS = 3, 12
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
ATTRIBUTION = r"(?i)^[ \t]*(?:on\b.*\bwrote|.* (?:wrote|writes|schrieb|a écrit|escribió)) ?:[ \t]*\r?$"
#: Stands for a null turn among numbers.
NO_TURN = -(1 << 62)


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def _runs() -> tuple[Column, Column, Column, Column]:
    """Runs of two or more neighbouring lines of one level with something in them, joined, in four steps, each over
    the column before: where runs begin, the runs, those that count, and their (level, plain)."""
    line = lambda i: F.get("lines", i)
    n = F.size("lines")
    differ = lambda i: (line(i)["level"] != line(i - 1)["level"]) | ((line(i)["plain"] == "") != (line(i - 1)["plain"] == ""))
    cuts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | F.coalesce(differ(i), F.lit(True)))
    each = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda k: F.slice("lines", F.get("cuts", k) + 1, F.get("cuts", k + 1) - F.get("cuts", k)))
    kept = F.filter("each", lambda run: (F.size(run) > 1) & (F.get(run, F.lit(0))["plain"] != ""))
    joined = F.transform("kept", lambda run: F.struct(F.get(run, F.lit(0))["level"].alias("level"), F.array_join(F.transform(run, lambda x: x["plain"]), " ").alias("plain")))
    return cuts, each, kept, joined


def passages(messages: DataFrame) -> DataFrame:
    """c, t, level, hash and whether it is long of every passage of messages (c, t, text)."""
    marks = lambda x: F.length(F.translate(F.regexp_extract(x, MARKS, 1), " \t", "")).cast("long")
    plain = lambda x: F.trim(F.regexp_replace(F.lower(F.regexp_replace(x, MARKS, "")), r"[^\p{L}\p{N}]+", " "))
    lines = messages.select("c", "t", F.transform(_lines(), lambda x: F.struct(marks(x).alias("level"), plain(x).alias("plain"))).alias("lines"))
    cuts, each, kept, joined = _runs()
    runs = lines.withColumn("cuts", cuts).withColumn("each", each).withColumn("kept", kept)
    every = runs.select("c", "t", F.explode(F.concat("lines", joined)).alias("x")).select("c", "t", "x.*").where("plain <> ''")
    long = (F.size(F.split("plain", " ")) >= MIN_WORDS) | (F.length("plain") >= MIN_CHARS)
    return every.select("c", "t", "level", F.xxhash64("plain").alias("hash"), long.alias("long"))


def links(found: DataFrame) -> DataFrame:
    """c, t, the turn replied to and how many of the message's quoted passages are linked."""
    written = materialize(found.where("level = 0 and t is not null").groupBy("c", "hash").agg(F.min("t").alias("origin")))
    quoted = materialize(found.where("level > 0 and t is not null").groupBy("c", "t", "hash", "long").agg(F.min("level").alias("level"), F.count(F.lit(1)).alias("n")))
    joined = quoted.join(written, ["c", "hash"]).where("origin < t")
    return joined.groupBy("c", "t").agg(F.max(F.struct("long", -F.col("level"), F.col("origin"))).getField("origin").alias("reply_to"), F.sum("n").alias("n_linked"))


def roots(replies: DataFrame) -> DataFrame:
    """c, t and root of every replying turn, by pointer jumping: log2(longest chain) joins."""
    now = materialize(replies.select("c", "t", F.col("reply_to").alias("root")))
    while True:
        up = now.select("c", F.col("t").alias("root"), F.col("root").alias("next"))
        step = now.join(up, ["c", "root"], "left").select("c", "t", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = materialize(step)
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def clean_text() -> Column:
    """The text without quoted lines, attributions of quotes, and blank lines at its ends."""
    lines = _lines()
    quoted = lambda x: x.rlike(MARKS)
    leads = lambda x, i: x.rlike(ATTRIBUTION) & F.coalesce(quoted(F.get(lines, i + 1)), F.lit(False))
    kept = F.filter(lines, lambda x, i: ~quoted(x) & ~leads(x, i))
    return F.regexp_replace(F.array_join(kept, "\n"), r"\A\s+|\s+\z", "")


def _placed(messages: DataFrame) -> DataFrame:
    """c, t0, h, salt, start, reply_to, root, n_linked and levels: what is known of all equal messages of a part of the
    table together."""
    found = materialize(passages(messages))
    reply = materialize(links(found))
    levels = found.where("level > 0").groupBy("c", F.coalesce("t", F.lit(NO_TURN)).alias("t0")).agg(F.max("level").alias("levels"))
    known = reply.join(roots(reply), ["c", "t"]).select("c", F.col("t").alias("t0"), "reply_to", "root", "n_linked")
    known = materialize(levels.join(known, ["c", "t0"], "left"))
    each = messages.groupBy("c", "t0", "h", "salt").agg(F.count(F.lit(1)).alias("n")).join(known, ["c", "t0"], "left")
    each = each.withColumn("r0", F.coalesce("root", "t0"))
    # ranges of the order are the buckets, stored so that they stay the same when they are read again
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(each.repartitionByRange(n, "c", "r0", "t0", "h", "salt").withColumn("bucket", F.spark_partition_id()))
    summed = running_sum(dealt, ["c"], ["bucket"], [F.col(x) for x in ("r0", "t0", "h", "salt")], "n", "upto")
    return summed.select("c", "t0", "h", "salt", (F.col("upto") - F.col("n")).alias("start"), "reply_to", "root", "n_linked", "levels")


def threads(messages: DataFrame) -> DataFrame:
    """row (the columns of messages), position (from 1, within the conversation), reply_to, root, n_quoted,
    n_linked, levels and clean of every message."""
    c = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    base = messages.select(packed(messages), c.alias("c"), F.col("turn").alias("t"), F.coalesce("turn", F.lit(NO_TURN)).alias("t0"), F.xxhash64("role", "text").alias("h"), "text")
    keys = ["c", "t0", "h", "salt"]
    n_quoted = F.size(F.filter(_lines(), lambda x: x.rlike(MARKS))).cast("long")
    own = F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(1)))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    with scratch(messages.sparkSession) as keep:
        # the part of the table that a row is in parts equal messages; stored, it stays the same in both reads
        base = materialize(base.withColumn("salt", F.spark_partition_id()))
        found = base.join(_placed(base.drop("row")), keys).select(
            "row", (F.col("start") + own).cast("long").alias("position"), "reply_to", F.coalesce("root", "t").alias("root"), n_quoted.alias("n_quoted"), zero("n_linked"), zero("levels"), clean_text().alias("clean")
        )
        return keep(found)


def op7_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = threads(read_table(spark, sf_dir, "conversations"))
    return t.select(
        "row.conv_id", "row.turn", "row.role", "position", "reply_to", "root", "n_quoted", "n_linked", F.col("levels").alias("quote_levels"),
        F.length("clean").cast("long").alias("clean_chars"), F.sha2("clean", 256).alias("clean_sha256"),
    )


ORACLE = r"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT rid, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM c),
m AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1), '[ \t]', '', 'g')) AS level,
             trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*((?:>[ \t]?)+)', '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS plain FROM l),
g AS (SELECT *, sum(cut) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT *, CASE WHEN level = lag(level) OVER w AND (plain = '') = (lag(plain) OVER w = '') THEN 0 ELSE 1 END AS cut
      FROM m WINDOW w AS (PARTITION BY rid ORDER BY i))),
q AS (SELECT *, len(string_split(plain, ' ')) >= 3 OR length(plain) >= 12 AS long FROM (SELECT rid, conv_id, turn, level, plain FROM m WHERE plain <> ''
      UNION ALL SELECT rid, conv_id, turn, any_value(level), string_agg(plain, ' ' ORDER BY i) FROM g WHERE plain <> '' GROUP BY rid, conv_id, turn, run HAVING count(*) > 1)),
w AS (SELECT conv_id, plain, min(turn) AS origin FROM q WHERE level = 0 AND turn IS NOT NULL GROUP BY 1, 2),
k AS (SELECT conv_id, turn, plain, any_value(long) AS long, min(level) AS level, count(*) AS n FROM q WHERE level > 0 AND turn IS NOT NULL GROUP BY 1, 2, 3),
j AS (SELECT k.conv_id, k.turn, arg_max(origin, origin - 1000000 * level + 1000000000 * CAST(long AS BIGINT)) AS reply_to, sum(n) AS n_linked
      FROM k JOIN w ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.plain = w.plain WHERE origin < turn GROUP BY 1, 2),
up AS (SELECT conv_id, turn, reply_to AS root FROM j UNION ALL SELECT up.conv_id, up.turn, j.reply_to FROM up JOIN j ON up.conv_id IS NOT DISTINCT FROM j.conv_id AND up.root = j.turn),
r AS (SELECT conv_id, turn, min(root) AS root FROM up GROUP BY 1, 2),
lv AS (SELECT conv_id, turn, max(level) AS levels FROM q WHERE level > 0 GROUP BY 1, 2),
n AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY rid ORDER BY i), 0) AS next_level FROM m),
t AS (SELECT rid, count(*) FILTER (WHERE level > 0) AS n_quoted, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT (next_level > 0
      AND regexp_matches(line, '(?i)^[ \t]*(?:on\b.*\bwrote|.* (?:wrote|writes|schrieb|a écrit|escribió)) ?:[ \t]*\r?$'))), '') AS kept FROM n GROUP BY rid)
SELECT c.conv_id, c.turn, c.role, row_number() OVER (PARTITION BY c.conv_id ORDER BY coalesce(r.root, c.turn) NULLS FIRST, c.turn NULLS FIRST) AS position, j.reply_to, coalesce(r.root, c.turn) AS root,
       CAST(t.n_quoted AS BIGINT) AS n_quoted, CAST(coalesce(j.n_linked, 0) AS BIGINT) AS n_linked, CAST(coalesce(lv.levels, 0) AS BIGINT) AS quote_levels,
       CAST(length(regexp_replace(t.kept, '\A\s+|\s+\z', '', 'g')) AS BIGINT) AS clean_chars, sha256(regexp_replace(t.kept, '\A\s+|\s+\z', '', 'g')) AS clean_sha256
FROM c JOIN t USING (rid) LEFT JOIN j ON c.conv_id IS NOT DISTINCT FROM j.conv_id AND c.turn = j.turn
LEFT JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.turn = r.turn LEFT JOIN lv ON c.conv_id IS NOT DISTINCT FROM lv.conv_id AND c.turn = lv.turn
"""
