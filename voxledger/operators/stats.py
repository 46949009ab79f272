"""Fleet statistics over orchestrator lines: counters, durations, latencies, cache hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.functions.prefix import previous, running_sum

#: Patterns of orchestrator lines.
CALL = r"\[CallId: ([a-f0-9]+)\]"
STAMP = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+[+-]\d{2}:\d{2})"
TTS_LATENCY = r"First ElevenLabs chunk received - latency: (\d+) ms"
CATEGORIZER_LATENCY = r"categorizer_client_call took ([\d.]+)ms"
TRANSITION = r"Transitioning from '([^']+)' to '([^']+)'"
HANGUP = r"WebSocket fechado após hangup por (\w+)"
NO_VOICE = "Timeout de detecção de voz expirado"
MISSING_AUDIO = r"Arquivo de áudio.*não encontrado: (.+?)\."
CACHE = r"cache:(HIT|MISS)"
ERROR_MODULE = r"ERROR - ([^\s-]+)"
WARNING_MODULE = r"WARNING - ([^\s-]+)"
DISCONNECT = r"Desconectando usuário (.+)"


def _part(pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract("text", pattern, group), F.lit(""))


def line_facts(lines: DataFrame) -> DataFrame:
    """What each line (line_no, text) tells, one column for each fact: a single pass for all statistics."""
    return lines.select(
        "line_no", _part(CALL).alias("call_id"), F.try_to_timestamp(_part(STAMP)).alias("ts"), _part(TTS_LATENCY).try_cast("double").alias("tts_ms"), _part(CATEGORIZER_LATENCY).try_cast("double").alias("categorizer_ms"),
        F.element_at(F.split(_part(TRANSITION, 2), "-"), -1).alias("stage"), _part(HANGUP).alias("hangup"), F.contains("text", F.lit(NO_VOICE)).alias("no_voice"), _part(MISSING_AUDIO).alias("missing_audio"), _part(CACHE).alias("cache"),
        F.when(F.contains("text", F.lit("ERROR -")), _part(ERROR_MODULE)).alias("error_module"), F.when(F.contains("text", F.lit("WARNING -")), _part(WARNING_MODULE)).alias("warning_module"), F.trim(_part(DISCONNECT)).alias("disconnect"),
    )


def top(rows: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    """The n most frequent values; of equal counts the one seen first."""
    each = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at"))
    return each.orderBy(F.desc("n"), "first_at", key).limit(n).select(key, "n")


def durations(rows: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Seconds from the first to the last row of each key in row order (not from least to greatest time);
    only positive ones."""
    ends = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key).agg(F.min_by(ts, order).alias("a"), F.max_by(ts, order).alias("b"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return ends.select(key, ((micros("b") - micros("a")) / 1e6).alias("seconds")).where("seconds > 0")


def duration_stats(seconds: DataFrame) -> DataFrame:
    """n, mean, upper median, max, min and how many are over 60 s, over 120 s and under 10 s."""
    s = F.col("seconds")
    base = seconds.agg(
        F.count(s).alias("n"), F.avg(s).alias("mean"), F.max(s).alias("max"), F.min(s).alias("min"),
        F.count_if(s > 60).alias("over_60"), F.count_if(s > 120).alias("over_120"), F.count_if(s < 10).alias("under_10"),
    )
    median = ranked_value(seconds, "seconds", 0.5).select(F.col("value").alias("upper_median"))
    return base.join(median, F.lit(True), "left").select("n", "mean", "upper_median", "max", "min", "over_60", "over_120", "under_10")  # one row each


def ranked_value(values: DataFrame, value: str, share: float) -> DataFrame:
    """The value at index int(n * share) in order, without gathering the values in one task: values are
    counted, and counts are added up in order."""
    each = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    bucketed = each.withColumn("__b", F.floor(F.col(value)))
    upto = running_sum(bucketed, [], ["__b"], [F.col(value)], "__n", "__upto")
    n = each.agg(F.sum("__n").alias("__total"))
    at = F.least(F.col("__total") - 1, F.floor(F.col("__total") * F.lit(share)))
    return upto.crossJoin(n).where((F.col("__upto") > at) & (F.col("__upto") - F.col("__n") <= at)).select(F.col(value).alias("value"))  # n is one row


def latency_stats(values: DataFrame, value: str) -> DataFrame:
    """n, mean, max, min, the index-0.95 value, and how many exceed 100 and 500."""
    v = F.col(value)
    base = values.where(v.isNotNull()).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.count_if(v > 100).alias("over_100"), F.count_if(v > 500).alias("over_500"))
    return base.crossJoin(ranked_value(values, value, 0.95).select(F.col("value").alias("p95")))  # one row each


def hit_rate(facts: DataFrame) -> DataFrame:
    """Cache hits, misses and the share of hits in percent."""
    hit, miss = F.count_if(F.col("cache") == "HIT"), F.count_if(F.col("cache") == "MISS")
    return facts.agg(hit.alias("hits"), miss.alias("misses"), F.when(hit + miss > 0, hit * 100.0 / (hit + miss)).alias("hit_rate"))


def totals(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("call_id").alias("calls"), F.count_if("no_voice").alias("no_voice_timeouts"))


def busy_call(facts: DataFrame, lines: int = 200, best: int = 20) -> DataFrame:
    """Of the `best` calls with most lines, the first with over `lines` of them, else the first."""
    ranked = top(facts, "call_id", "line_no", best)
    return ranked.orderBy((F.col("n") > lines).desc(), F.desc("n")).limit(1)


def transitions(rows: DataFrame, key: str, order: str, value: str, bucket_rows: int = 100_000) -> DataFrame:
    """How often each value follows which within a key: from_value, to_value, n. The order is a number."""
    bucketed = rows.select(key, order, value, F.floor(F.col(order) / bucket_rows).alias("__bucket"))
    near = previous(bucketed, [key], ["__bucket"], [order], value, "from_value")
    return near.where("from_value is not null").groupBy("from_value", F.col(value).alias("to_value")).agg(F.count(F.lit(1)).alias("n"))
