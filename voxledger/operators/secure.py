"""The secure view of an answer: one numbering of all its sensitive values, one verdict over all its parts.

An answer is a table of values (analysis_id, part, seq, type, value). Values of a known type (the query, identifiers,
typed fields, file references) stand for themselves; in all others sensitive spans are detected. Each distinct
(type, comparable form) of an analysis has one placeholder, numbered by first occurrence: by part in the order of
PARTS, then seq, then place; where the values hold placeholders already, after the greatest of these. In values without a type, detected spans become their placeholders, and so does every
variant of a value that the analysis knows (as it was written, bare, or in its comparable form), wherever it stands:
an Aho-Corasick automaton of the variants looks for all of them at once. Of overlapping candidates the leftmost and
longest wins; a detected span that another value cuts in part is an error, for nothing may leak by a guess.

The scanner, which shares no code with the detectors, looks at what comes out. One error or one finding in any part
suppresses the whole analysis (`state` SUPRIMIDA, all its values null); others are CONCLUIDA.

No analysis is ever one task: values are counted and numbered by ranges, variants are cut into blocks and texts into
chunks, and only a block meets a chunk.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from voxledger.functions.identifiers import peel
from voxledger.functions.prefix import running_sum
from voxledger.functions.store import materialize, scratch
from voxledger.operators import sanitize, scanner

#: The parts of an answer, in the order in which their values are numbered.
PARTS = ("query", "identifiers", "fields", "files", "links", "evidence", "rules", "texts")
#: Most variants in an automaton, and most texts that are searched by one task.
BLOCK, CHUNK = 50_000, 20_000
DONE, SUPPRESSED = "CONCLUIDA", "SUPRIMIDA"


@arrow_udf(T.StringType())
def _comparable(kind: pa.Array, value: pa.Array) -> pa.Array:
    """The comparable form of typed values; null if they are neutral or placeholders."""
    return pa.array([None if k is None or v is None else sanitize.normalize(k, v, True) for k, v in zip(kind.to_pylist(), value.to_pylist(), strict=True)], pa.string())


@arrow_udf(T.ArrayType(T.StringType()))
def _variants(written: pa.Array, normalized: pa.Array) -> pa.Array:
    """What a value may look like elsewhere."""
    out = []
    for w, n in zip(written.to_pylist(), normalized.to_pylist(), strict=True):
        forms = dict.fromkeys((w, w.strip(), peel(w), n))
        out.append([f for f in forms if f and not sanitize.PLACEHOLDER.fullmatch(f)])
    return pa.array(out, pa.list_(pa.string()))


def found_values(values: DataFrame) -> DataFrame:
    """values with `rank` (of the part) and `d`: their spans and, where detection failed, its error."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PARTS]), F.col("part")), F.lit(len(PARTS) + 1)).cast("int")
    keyed = values.withColumns({"rank": rank, "known": _comparable("type", "value")})
    whole = F.struct(F.col("type"), F.lit(0).alias("span_start"), F.char_length("value").alias("span_end"), F.col("known").alias("normalized"))
    typed = F.struct(F.when(F.col("known").isNotNull(), F.array(whole)).otherwise(F.array().cast(T.ArrayType(sanitize.SPAN))).alias("spans"), F.lit(None).cast("string").alias("error"))
    return keyed.withColumn("d", F.when(F.col("type").isNotNull(), typed).otherwise(sanitize.detected(F.when(F.col("type").isNull(), F.col("value"))))).drop("known")


def taken(values: DataFrame) -> DataFrame:
    """analysis_id, type and the greatest number of a placeholder that the values hold already."""
    marks = F.explode(F.regexp_extract_all("value", F.lit(scanner.PLACEHOLDER), F.lit(0))).alias("mark")
    each = values.where(F.col("value").contains("<")).select("analysis_id", marks)
    kind, number = F.regexp_extract("mark", r"^<(\w+)_\d+>$", 1), F.regexp_extract("mark", r"(\d+)>$", 1).try_cast("long")
    return each.groupBy("analysis_id", kind.alias("type")).agg(F.max(number).alias("taken"))


def placeholders(found: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """analysis_id, type, normalized, placeholder and first: numbered by first occurrence within analysis and type, after
    the numbers that are taken."""
    place = F.struct("rank", "seq", "s.span_start").alias("place")
    each = found.select("analysis_id", F.explode("d.spans").alias("s"), "rank", "seq").select("analysis_id", "s.type", "s.normalized", place)
    each = each.groupBy("analysis_id", "type", "normalized").agg(F.min("place").alias("first"))
    # ranges of the order are the buckets, written so that they stay the same when they are read again
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = each.repartitionByRange(n, "analysis_id", "type", "first").withColumns({"one": F.lit(1).cast("long"), "bucket": F.spark_partition_id()})
    numbered = running_sum(materialize(dealt), ["analysis_id", "type"], ["bucket"], [F.col("first")], "one", "n")
    if reserved is not None:
        numbered = numbered.join(reserved, ["analysis_id", "type"], "left").withColumn("n", F.col("n") + F.coalesce("taken", F.lit(0)))
    return numbered.select("analysis_id", "type", "normalized", F.format_string("<%s_%d>", F.col("type"), F.col("n")).alias("placeholder"), "first")


def known_variants(found: DataFrame, names: DataFrame) -> DataFrame:
    """analysis_id, variant, any_case, placeholder and block: a variant of several values is the first one's."""
    spans = found.select("analysis_id", "value", F.explode("d.spans").alias("s"))
    written = F.substring("value", F.col("s.span_start") + 1, F.col("s.span_end") - F.col("s.span_start"))
    each = spans.select("analysis_id", "s.type", "s.normalized", written.alias("written")).distinct().join(names, ["analysis_id", "type", "normalized"])
    any_case = F.col("type").isin(*sanitize.ANY_CASE)
    each = each.select("analysis_id", F.explode(_variants("written", "normalized")).alias("v"), any_case.alias("any_case"), "placeholder", "first")
    each = each.select("analysis_id", F.when(F.col("any_case"), F.lower("v")).otherwise(F.col("v")).alias("variant"), "any_case", "placeholder", "first")
    each = each.groupBy("analysis_id", "variant", "any_case").agg(F.min_by("placeholder", "first").alias("placeholder"))
    blocks = each.groupBy("analysis_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    return each.join(blocks, "analysis_id").withColumn("block", F.pmod(F.xxhash64("variant"), F.col("blocks")).cast("int"))


HITS = pa.schema([("row", pa.int64()), ("spans", pa.list_(pa.struct([("span_start", pa.int32()), ("span_end", pa.int32()), ("placeholder", pa.string())])))])


def _lowered(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    return text.lower() if text.isascii() else "".join(low if len(low := c.lower()) == 1 else c for c in text)


def _search(texts: pa.Table, variants: pa.Table) -> pa.Table:
    """Where the variants of a block stand in the texts of a chunk: of those that begin at a place the longest."""
    kinds = {True: ahocorasick.Automaton(), False: ahocorasick.Automaton()}
    for v, any_case, name in zip(*(variants.column(c).to_pylist() for c in ("variant", "any_case", "placeholder")), strict=True):
        kinds[any_case].add_word(v, (len(v), name))
    rows, out = [], []
    for automaton in kinds.values():
        if len(automaton):
            automaton.make_automaton()
    for row, text in zip(texts.column("row").to_pylist(), texts.column("value").to_pylist(), strict=True):
        best: dict[int, tuple[int, str]] = {}
        for any_case, automaton in kinds.items():
            if len(automaton):
                for end, (size, name) in automaton.iter(_lowered(text) if any_case else text):
                    best[end + 1 - size] = max(best.get(end + 1 - size, (0, "")), (end + 1, name))
        if best:
            rows.append(row)
            out.append([{"span_start": a, "span_end": b, "placeholder": name} for a, (b, name) in sorted(best.items())])
    return pa.table({"row": pa.array(rows, pa.int64()), "spans": pa.array(out, HITS.field("spans").type)}, schema=HITS)


def variant_hits(texts: DataFrame, variants: DataFrame) -> DataFrame:
    """row and spans (with placeholders) of known variants in texts (analysis_id, row, value)."""
    chunks = texts.groupBy("analysis_id").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    blocks = variants.select("analysis_id", "blocks").distinct()
    plan = materialize(chunks.join(blocks, "analysis_id"))
    left = texts.join(plan, "analysis_id").select("analysis_id", "row", "value", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = variants.drop("blocks").join(plan.drop("blocks"), "analysis_id").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    by = ["analysis_id", "chunk", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search, "row long, spans array<struct<span_start: int, span_end: int, placeholder: string>>")


def rewritten(text: str, detected: list[dict], known: list[dict]) -> str | None:
    """The text with its spans replaced; None if a detected span and another overlap in part. Placeholders that the
    text has already are left alone."""
    guarded = [m.span() for m in sanitize.PLACEHOLDER.finditer(text)]
    spans = [(s["span_start"], -s["span_end"], 0, s["placeholder"]) for s in detected]
    spans += [(s["span_start"], -s["span_end"], 1, s["placeholder"]) for s in known if not any(a < s["span_end"] and s["span_start"] < b for a, b in guarded)]
    out, at, last = [], 0, 1
    for start, minus_end, rank, name in sorted(spans):
        end = -minus_end
        if start < at:
            if end > at and 0 in (rank, last):
                return None
            continue
        out += [text[at:start], name]
        at, last = end, rank
    return "".join([*out, text[at:]])


@arrow_udf(T.StringType())
def _rewrite(text: pa.Array, detected: pa.Array, known: pa.Array) -> pa.Array:
    return pa.array([None if t is None else rewritten(t, d or [], k or []) for t, d, k in zip(text.to_pylist(), detected.to_pylist(), known.to_pylist(), strict=True)], pa.string())


def sanitized(values: DataFrame) -> DataFrame:
    """The columns of values (analysis_id, part, seq, type, value) with `safe` and `failed`."""
    found = materialize(found_values(values).withColumn("row", F.monotonically_increasing_id()))
    names = materialize(placeholders(found, materialize(taken(found))))
    variants = materialize(known_variants(found, names))
    spans = found.select("row", "analysis_id", F.explode("d.spans").alias("s")).select("row", "analysis_id", "s.*").join(names.drop("first"), ["analysis_id", "type", "normalized"])
    own = spans.groupBy("row").agg(F.collect_list(F.struct("span_start", "span_end", "placeholder")).alias("own"))
    free = found.where("type is null and value is not null and d.error is null")
    hits = variant_hits(free.select("analysis_id", "row", "value"), variants)
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("known"))
    joined = found.join(own, "row", "left").join(hits, "row", "left")
    whole = F.coalesce(F.col("own")[0]["placeholder"], F.col("value"))
    text = lambda c: F.when(F.col("type").isNull(), F.col(c))  # noqa: E731  spans of typed values aren't sent to Python
    safe = F.when(F.col("type").isNotNull(), whole).when(F.col("d.error").isNull(), _rewrite(text("value"), text("own"), "known"))
    return joined.select(*values.columns, safe.alias("safe")).withColumn("failed", F.col("value").isNotNull() & F.col("safe").isNull())


def secure_view(values: DataFrame) -> DataFrame:
    """analysis_id, part, seq, type, safe and state of all values of answers (analysis_id, part, seq, type, value);
    seq is of any type that has an order."""
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with scratch(values.sparkSession) as keep:
        # values may come from a source of few ranges, but what is done with each is dear
        dealt = values.select("analysis_id", "part", "seq", "type", "value").repartition(n, "analysis_id", "part", "seq")
        safe = sanitized(dealt)
        safe = materialize(safe.withColumn("bad", F.col("failed") | (scanner.findings(F.col("safe")) > 0)).drop("value", "failed"))
        # the stored table's size tells Spark whether it may be broadcast
        bad = materialize(safe.where("bad").select("analysis_id").distinct().withColumn("__bad", F.lit(True)))
        good = F.col("__bad").isNull()
        shown = safe.join(bad, "analysis_id", "left")
        return keep(shown.select("analysis_id", "part", "seq", "type", F.when(good, F.col("safe")).alias("safe"), F.when(good, DONE).otherwise(SUPPRESSED).alias("state")))


def secure_texts(texts: DataFrame) -> DataFrame:
    """The secure view of answers that are texts alone (analysis_id, seq, text): analysis_id, seq, safe, state."""
    none: Column = F.lit(None).cast("string")
    return secure_view(texts.select("analysis_id", F.lit("texts").alias("part"), "seq", none.alias("type"), F.col("text").alias("value"))).select("analysis_id", "seq", "safe", "state")
