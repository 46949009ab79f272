"""Operator 1: quality rules as weak supervision, in DataFrame functions alone.

Each rule looks at counts of the whole text and votes good (1), bad (-1) or abstains (0). The votes are modelled
as independent given a hidden quality, and an abstention says nothing: expectation-maximisation over the table of
vote patterns (at most 3^9 rows, whatever the corpus) estimates of each rule how often it votes bad on good
documents and good on bad ones, and a document's posterior probability of being good replaces all-must-pass
filtering. Both error rates start from a prior of WEIGHT documents and stay at FLOOR or more: no rule is trusted
beyond one error in a hundred, so good votes of several rules can outvote a bad one. A rule's bad vote is never
read as a sign of quality (its error rates add up to one at most), so documents without a bad vote are at least
as probably good as the whole corpus. The E and M steps are one aggregation over the pattern table a round; only
its sums come to the driver.

Repeated 3-word windows are found in place: each window's 64-bit hash has its low bits replaced by the
window's position, one primitive sort brings equal windows together, neighbours that agree above the
position bits and word by word are marked, and covered words are counted from the sorted positions.
No text is shuffled.

Null and empty texts have no words: all counts are 0, base_failed is true and kept false. Repeated rows are
judged one by one and alike. In an empty table there is nothing to learn and no row to return. Columns but doc_id
and text, whatever their names, are not read. A text of any length is one row of arrays, linear in its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, materialize, read_table, scratch

ROUNDS = 60
#: First guesses: the share of good documents, and how often a rule that votes errs on good and on bad ones.
START_PRIOR = 0.9
ERR_GOOD, ERR_BAD = 0.02, 0.6
#: How many documents the first guesses of a rule's error rates count as, and the least error rate.
WEIGHT = 20.0
FLOOR = 0.01
KEEP = 0.5


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the further counts that rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("t"), F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0)).alias("w"))
    split = split.withColumns({"n_words": F.size("w").cast("long"), "lines": F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD_RE))})
    bits = F.length(F.bin(F.size("w"))).cast("int")

    def high(x: Column) -> Column:
        """x without its low bits, which hold a position."""
        return F.call_function("shiftleft", F.call_function("shiftright", x, F.col("bits")), F.col("bits"))

    def packed(i: Column) -> Column:
        h = F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
        return high(h).bitwiseOR(i.cast("long"))

    windows = F.when(F.size("w") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("w") - 3), packed))).otherwise(F.array().cast("array<bigint>"))
    sized = split.withColumn("bits", bits)
    sorted_ = sized.select("*", windows.alias("s"))

    def place(x: Column) -> Column:
        return (x - high(x)).cast("int")

    def twin(x: Column, y: Column) -> Column:
        a, b = place(x), place(y)
        same = high(x) == high(y)
        for k in range(3):
            same = same & (F.get("w", a + k) == F.get("w", b + k))
        return F.coalesce(same, F.lit(False))

    twice = F.filter("s", lambda x, i: twin(x, F.get("s", i - 1)) | twin(x, F.get("s", i + 1)))
    marked = sorted_.select("*", F.sort_array(F.transform(twice, place)).alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, i: F.coalesce(F.least(F.lit(3), x - F.get("p", i - 1)), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x)
    return marked.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.regexp_count("t", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit("!!")).cast("long").alias("n_bangs"),
        F.regexp_count("t", F.lit(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)")).cast("long").alias("n_bare"),
    )


def votes() -> dict[str, Column]:
    """The rules: bad if the first condition holds, good if the second does, else no vote."""
    n, symbols, chars, letters, capitals = F.col("n_words"), F.col("n_symbols"), F.col("word_chars"), F.col("n_letters"), F.col("n_capitals")
    lines, dup, repeats, distinct = F.col("n_lines"), F.col("n_dup_lines"), F.col("n_repeat_words"), F.col("n_distinct")

    def rule(bad: Column, good: Column) -> Column:
        return F.when(n == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    return {
        "symbols": rule(symbols * 10 > n, symbols * 50 <= n),
        "bare_marks": rule(F.col("n_bare") * 10 > n, F.col("n_bare") * 50 <= n),
        "dup_lines": rule((dup * 2 > lines) & (lines >= 4), (dup == 0) & (lines >= 2)),
        "repeats": rule(repeats * 5 > n * 2, repeats * 10 <= n),
        "distinct": rule((distinct * 5 < n) & (n < 2000), distinct * 3 >= n),
        "capitals": rule(capitals * 10 > letters * 4, capitals * 10 <= letters),
        "bangs": rule(F.col("n_bangs") * 10 > n, F.col("n_bangs") == 0),
        "word_length": rule((chars < n * 2) | (chars > n * 20), (chars >= n * 4) & (chars <= n * 8)),
        "letters": rule(letters * 100 < chars * 88, letters * 100 >= chars * 92),
    }


def _posterior(errors: dict[str, tuple[float, float]], prior: float) -> Column:
    """Probability of good quality, from the log likelihood ratios of the votes cast."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, (on_good, on_bad) in errors.items():
        v = F.col(name)
        odds = odds + F.when(v < 0, math.log(on_good / (1 - on_bad))).when(v > 0, math.log((1 - on_good) / on_bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rules: list[str], rounds: int = ROUNDS) -> Column:
    """EM on patterns (rule votes and n, the documents with them); returns the posterior expression."""
    errors, prior = {r: (ERR_GOOD, ERR_BAD) for r in rules}, START_PRIOR
    for _ in range(rounds):
        mass = {"good": F.col("n") * F.col("p"), "bad": F.col("n") * (1 - F.col("p"))}
        sums = [F.sum(w).alias(q) for q, w in mass.items()]
        sums += [F.sum(F.when(F.col(r) == v, w).otherwise(0.0)).alias(f"{r}/{q}/{v}") for r in rules for v in (-1, 1) for q, w in mass.items()]
        row = patterns.withColumn("p", _posterior(errors, prior)).agg(*sums).first()
        if row["good"] is None:
            break
        new = {}
        for r in rules:
            seen = lambda q, v, r=r: row[f"{r}/{q}/{v}"]
            on_good = (seen("good", -1) + WEIGHT * ERR_GOOD) / (seen("good", -1) + seen("good", 1) + WEIGHT)
            on_bad = (seen("bad", 1) + WEIGHT * ERR_BAD) / (seen("bad", -1) + seen("bad", 1) + WEIGHT)
            on_good = min(0.5, max(FLOOR, on_good))
            new[r] = (on_good, min(1 - on_good, max(FLOOR, on_bad)))
        moved = max(abs(a - b) for r in rules for a, b in zip(new[r], errors[r], strict=True))
        errors, prior = new, min(0.999, max(0.5, row["good"] / (row["good"] + row["bad"])))
        if moved < 1e-4:
            break
    return _posterior(errors, prior)


def judge(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, the base counts, each rule's vote, the posterior quality and the verdict of every row."""
    with scratch(docs.sparkSession) as keep:
        rules = votes()
        voted = keep(base_counts(docs).withColumns({f"vote_{r}": c for r, c in rules.items()}))
        names = [f"vote_{r}" for r in rules]
        patterns = materialize(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
        failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        judged = voted.withColumns({"quality": F.round(estimate(patterns, names, rounds), 6), "base_failed": failed})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )
