"""The graph of links between identifiers: closure, components and ambiguity by cardinality."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.functions.store import materialize

EDGES = "src string, dst string, relation string, schema_id string, schema_version int, cardinality string, allows_correlation boolean, entry_id string, src_type string, dst_type string"
#: Cardinalities; the sides that must have one partner.
ONE_SOURCE, ONE_TARGET = ("1:1", "1:N"), ("1:1", "N:1")


def node_of() -> Column:
    """An identifier (namespace, normalized) as a node of the graph."""
    return F.concat_ws("\u0000", "namespace", "normalized")


def both_ways(edges: DataFrame) -> DataFrame:
    """src and dst of each edge and of its reverse, stored: pairs are told apart once, before they are turned round, so that
    one of edges that run either way between two nodes may be there twice."""
    pairs = materialize(edges.select("src", "dst").where("src <> dst").distinct())
    return pairs.union(pairs.select("dst", "src"))


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, ways: DataFrame | None = None) -> DataFrame:
    """Every node that a seed `source` reaches by edges either way: source, node, depth (of a shortest path) and parent,
    the least node before it on such paths. `ways` are both_ways() of the edges, for who has them.

    Breadth first: each round joins the frontier with the edges and keeps nodes not seen from that source. Rounds are
    stored once and never rewritten, and a row doesn't grow with its depth; paths() follows the parents.
    """
    step = both_ways(edges) if ways is None else ways
    seen = materialize(seeds.select("source", F.col("source").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).distinct())
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.select("source", F.col("node").alias("src")).join(step, "src").groupBy("source", F.col("dst").alias("node")).agg(F.lit(depth).alias("depth"), F.min("src").alias("parent"))
        frontier = materialize(new.join(seen.select("source", "node"), ["source", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def steps(reach: DataFrame, ends: DataFrame) -> DataFrame:
    """The steps of the paths from `source` to `node` of ends: source, node, at (from 1), a, b. Parents are followed
    from the ends back, a join each step."""
    links = reach.where("depth > 0").select("source", F.col("node").alias("b"), F.col("parent").alias("a"), F.col("depth").alias("at"))
    now = materialize(ends.select("source", "node").distinct().join(links.withColumn("node", F.col("b")), ["source", "node"]))
    out = now
    while not (more := now.where("at > 1")).isEmpty():
        back = more.select("source", "node", F.col("a").alias("b"))
        now = materialize(back.join(links, ["source", "b"]).select("source", "node", "b", "a", "at"))
        out = out.unionByName(now)
    return out.select("source", "node", "at", "a", "b")


def paths(found: DataFrame) -> DataFrame:
    """source, node and path (all nodes in order) of steps."""
    ordered = F.sort_array(F.collect_list(F.struct("at", "b")))
    return found.groupBy("source", "node").agg(F.concat(F.array("source"), F.transform(ordered, lambda x: x["b"])).alias("path"))


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node): labels fall to the least neighbour's label, and to the label of
    the label, until nothing moves."""
    pairs = both_ways(edges)
    labels = materialize(pairs.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("component")))
    while True:
        near = pairs.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("low"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = labels.join(near, "node").join(hop, "component", "left").select("node", F.least("component", "low", "up").alias("component"), (F.least("component", "low", "up") < F.col("component")).alias("moved"))
        new = materialize(new)
        if new.where("moved").isEmpty():
            return new.drop("moved")
        labels = new.drop("moved")


@dataclass(frozen=True)
class LinkSchema:
    """What makes two identifiers of one entry linked: their types and, if given, a test of both (Columns of their
    structs). `cardinality` is one of 1:1, 1:N, N:1 and N:N."""

    schema_id: str
    schema_version: int
    relation: str
    cardinality: str
    allows_correlation: bool
    source_types: tuple[str, ...]
    target_types: tuple[str, ...]
    test: Callable[[Column, Column], Column] | None = None
    approved: bool = True


def _declared(s: LinkSchema) -> Column:
    """array<struct> of the edges that an entry declares by one schema."""

    def node(i: Column) -> Column:
        return F.concat_ws("\u0000", i["namespace"], i["normalized"])

    def fits(a: Column, b: Column) -> Column:
        return (node(a) != node(b)) & (F.lit(True) if s.test is None else F.coalesce(s.test(a, b), F.lit(False)))

    def ends(a: Column, b: Column) -> Column:
        return F.struct(node(a).alias("src"), node(b).alias("dst"), a["type"].alias("src_type"), b["type"].alias("dst_type"))

    def of(types: tuple[str, ...]) -> Column:
        return F.filter("identifiers", lambda i: i["type"].isin(*types))

    pairs = F.flatten(F.transform(of(s.source_types), lambda a: F.transform(F.filter(of(s.target_types), lambda b: fits(a, b)), lambda b: ends(a, b))))
    told = {"relation": s.relation, "schema_id": s.schema_id, "schema_version": s.schema_version, "cardinality": s.cardinality, "allows_correlation": s.allows_correlation}
    return F.transform(F.array_distinct(pairs), lambda p: F.struct(*[p[c].alias(c) for c in ("src", "dst", "src_type", "dst_type")], *[F.lit(v).alias(k) for k, v in told.items()]))


def recognise(entries: DataFrame, schemas: list[LinkSchema]) -> DataFrame:
    """Edges that entries (entry_id, identifiers) declare by the latest approved version of each schema: pairs of
    identifiers of one entry, made and tested row by row. Entries are gone through once for all schemas."""
    return declared(entries, schemas).distinct()


def declared(entries: DataFrame, schemas: list[LinkSchema]) -> DataFrame:
    """recognise() of entries whose ids differ: each tells its edges once, so none is compared with another's."""
    latest: dict[str, LinkSchema] = {}
    for s in sorted((s for s in schemas if s.approved), key=lambda s: s.schema_version):
        latest[s.schema_id] = s
    if not latest:
        return entries.sparkSession.createDataFrame([], EDGES)
    edges = F.concat(*[_declared(s) for _, s in sorted(latest.items())])
    # explode() would have the optimizer make the edges twice, once to tell whether there are any
    each = entries.select("entry_id", F.explode_outer(edges).alias("p")).where("p IS NOT NULL")
    names = [f.split()[0] for f in EDGES.split(", ")]
    return each.select(*["entry_id" if n == "entry_id" else f"p.{n}" for n in names])


def latest_schemas(schemas: DataFrame) -> DataFrame:
    """The highest approved version of each link schema."""
    return schemas.where("approved").groupBy("schema_id").agg(F.max_by(F.struct("*"), "schema_version").alias("s")).select("s.*")


def recognised(declarations: DataFrame, schemas: DataFrame) -> DataFrame:
    """Edges from declarations (src, dst, src_type, dst_type, entry_id, src_entry, dst_entry, schema_id): the
    schema's latest version allows both types, and everything comes from one entry."""
    own = declarations.join(latest_schemas(schemas), "schema_id")
    fits = F.array_contains("source_types", F.col("src_type")) & F.array_contains("target_types", F.col("dst_type"))
    one_entry = (F.col("src_entry") == F.col("entry_id")) & (F.col("dst_entry") == F.col("entry_id"))
    kept = own.where(fits & one_entry & (F.col("src") != F.col("dst")))
    return kept.select("src", "dst", "relation", "schema_id", "schema_version", "cardinality", "allows_correlation", "entry_id", "src_type", "dst_type").dropDuplicates(["src", "dst", "relation", "schema_id", "schema_version", "entry_id", "src_type", "dst_type"])


def cardinality_violations(edges: DataFrame) -> DataFrame:
    """(node, schema_id, schema_version, partners) where a node has more partners than its schema allows."""
    by = ["schema_id", "schema_version", "cardinality"]
    out = edges.groupBy(*by, F.col("src").alias("node")).agg(F.count_distinct("dst").alias("partners")).where(F.col("cardinality").isin(*ONE_TARGET) & (F.col("partners") > 1))
    back = edges.groupBy(*by, F.col("dst").alias("node")).agg(F.count_distinct("src").alias("partners")).where(F.col("cardinality").isin(*ONE_SOURCE) & (F.col("partners") > 1))
    return out.union(back).select("node", "schema_id", "schema_version", "partners")


def _violating(edges: DataFrame) -> DataFrame:
    """node of cardinality_violations(), which need no count: a node with several partners has a least and another greatest one."""
    by = ["schema_id", "schema_version", "cardinality"]

    def several(node: str, partner: str, sides: tuple[str, ...]) -> DataFrame:
        each = edges.where(F.col("cardinality").isin(*sides)).groupBy(*by, F.col(node).alias("node")).agg(F.min(partner).alias("least"), F.max(partner).alias("greatest"))
        return each.where("least <> greatest").select("node")

    return several("src", "dst", ONE_TARGET).union(several("dst", "src", ONE_SOURCE)).distinct()


def with_ambiguity(edges: DataFrame) -> DataFrame:
    """edges with `ambiguous`: one violation makes all edges of its component ambiguous. Without any, there is no component to
    look for."""
    violating = materialize(_violating(edges))
    if violating.isEmpty():
        return edges.withColumn("ambiguous", F.lit(False))
    parts = materialize(components(edges))
    bad = parts.join(violating, "node", "left_semi").select("component").distinct()
    poisoned = materialize(parts.join(bad, "component", "left_semi").select(F.col("node").alias("src"), F.lit(True).alias("__bad")))
    return edges.join(poisoned, "src", "left").withColumn("ambiguous", F.coalesce("__bad", F.lit(False))).drop("__bad")
