"""Correlation of two applications on evidence: shared identifier values, or paths of allowed links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a correlation rests on, and why there is none.
SHARED, CHAIN, NONE, AMBIGUOUS = "valor_compartilhado", "cadeia_de_vinculos", "nenhuma", "ambigua"
NO_VPL = "Lado VPL ausente para correlação evidenciada."
NO_ORK = "Lado ORK ausente para correlação evidenciada."


def shared_values(left: DataFrame, right: DataFrame, keys: list[str], ambiguous: DataFrame | None = None) -> DataFrame:
    """Every occurrence on either side whose key the other side has too: evidence, with its side.

    Occurrences of ambiguous keys are taken out first; a key with an empty side then doesn't match.
    Two semi joins: occurrences are never paired, so a value that everything shares costs one row each.
    """
    if ambiguous is not None:
        left, right = (x.join(ambiguous.select(*keys).distinct(), keys, "left_anti") for x in (left, right))
    a = left.join(right.select(*keys), keys, "left_semi").withColumn("side", F.lit("left"))
    b = right.join(left.select(*keys), keys, "left_semi").withColumn("side", F.lit("right"))
    return a.unionByName(b, allowMissingColumns=True)


def shared_identifiers(identifiers: DataFrame, ambiguous: DataFrame | None = None) -> DataFrame:
    """Shared-value evidence between VPL and ORK identifiers (namespace, normalized)."""
    keys = ["namespace", "normalized"]
    found = shared_values(identifiers.where("app = 'VPL'"), identifiers.where("app = 'ORK'"), keys, ambiguous)
    return found.withColumns({"kind": F.lit("identificador_compartilhado"), "condition": F.concat(F.lit(SHARED + ":"), "namespace")})


def chains(identifiers: DataFrame, reach: DataFrame) -> DataFrame:
    """(source, node) of paths from a VPL node to an ORK node by one or more allowed links."""
    node = F.concat_ws("\u0000", "namespace", "normalized")
    side = lambda app: identifiers.where(F.col("app") == app).select(node.alias("n")).distinct()
    ends = reach.where("depth >= 1").select("source", "node")
    return ends.join(side("VPL").withColumnRenamed("n", "source"), "source", "left_semi").join(side("ORK").withColumnRenamed("n", "node"), "node", "left_semi")


def valid_chains(found: DataFrame, edges: DataFrame, selected: DataFrame) -> DataFrame:
    """(source, node) of paths, given by their steps (source, node, at, a, b), all of whose steps are unambiguous
    allowed edges that a selected entry declares."""
    return chains_of(found, edges.where("allows_correlation and not ambiguous").join(selected.select("entry_id"), "entry_id", "left_semi"))


def chains_of(found: DataFrame, good: DataFrame) -> DataFrame:
    """The same of edges that are known to be good."""
    pairs = good.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(good.select("dst", "src")).distinct().withColumn("ok", F.lit(True))
    return found.join(pairs, ["a", "b"], "left").groupBy("source", "node").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("valid")).where("valid").drop("valid")


def summary(entries: DataFrame, evidence: DataFrame, paths: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """One row: found, base, reason, and how many pieces of evidence and paths there are."""
    sides = entries.agg(F.count_if(F.col("app") == "VPL").alias("vpl"), F.count_if(F.col("app") == "ORK").alias("ork"))
    n = lambda df, name: (df if df is not None else entries.limit(0)).agg(F.count(F.lit(1)).alias(name))
    row = sides.crossJoin(n(evidence, "n_evidence")).crossJoin(n(paths, "n_paths")).crossJoin(n(blocked, "n_blocked"))  # one row each
    both = (F.col("vpl") > 0) & (F.col("ork") > 0)
    base = F.when(both & (F.col("n_evidence") > 0), SHARED).when(both & (F.col("n_paths") > 0), CHAIN).when(both & (F.col("n_blocked") > 0), AMBIGUOUS).otherwise(NONE)
    reason = F.when(F.col("vpl") == 0, NO_VPL).when(F.col("ork") == 0, NO_ORK)
    return row.select(base.isin(SHARED, CHAIN).alias("found"), base.alias("base"), reason.alias("reason"), "n_evidence", "n_paths")


def presence(entries: DataFrame, apps: list[str]) -> tuple[DataFrame, DataFrame]:
    """Legacy rule: all entries are correlated if every application has some; else an error row for each
    missing application."""
    have = entries.select("app").distinct()
    wanted = entries.sparkSession.createDataFrame([(a,) for a in apps], "app string")
    missing = wanted.join(have, "app", "left_anti").withColumn("description", F.lit("no entries"))
    all_there = have.where(F.col("app").isin(*apps)).agg((F.count(F.lit(1)) == len(set(apps))).alias("correlated"))
    return entries.crossJoin(all_there), missing


def presence_by(entries: DataFrame, group: list[str], wanted: int) -> DataFrame:
    """The same rule group by group: how many applications each has, and whether those are all."""
    n = F.count_distinct("app")
    return entries.groupBy(*group).agg(n.alias("apps"), (n == wanted).alias("correlated"))
