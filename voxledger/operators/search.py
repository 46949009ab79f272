"""Search: entries that hold a query structurally or literally, and expansion along links."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.functions.identifiers import casefold, normalize_query
from voxledger.functions.store import materialize

#: Why an entry was found.
STRUCTURED, LITERAL, EXPANDED, EVIDENCE = "IGUALDADE_ESTRUTURADA", "FALLBACK_LITERAL", "EXPANSAO_POR_VINCULO", "EVIDENCIA_DE_VINCULO"


def contains_text(rows: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows whose text holds the needle, whatever its case."""
    return rows.where(F.contains(F.lower(column), F.lit(needle.lower())))


def exploded_identifiers(entries: DataFrame) -> DataFrame:
    """One row for each identifier of each entry: the table that joins work on."""
    return entries.select("file_token", "app", "entry_id", "read_order", "line_start", F.explode("identifiers").alias("i")).select("file_token", "app", "entry_id", "read_order", "line_start", "i.*")


def _padded(key: bytes, byte: int) -> bytes:
    """The key as a block of SHA-256, combined with a byte."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(k ^ byte for k in block)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """The HMAC of a binary column in hex, by JVM functions alone."""
    inner = F.unhex(F.sha2(F.concat(F.lit(_padded(key, 0x36)), message), 256))
    return F.sha2(F.concat(F.lit(_padded(key, 0x5C)), inner), 256)


def keyed_digest(namespace: Column, normalized: Column, key: bytes) -> Column:
    """A digest that compares like (namespace, normalized) and tells neither to who lacks the key. The namespace's length
    in two bytes goes before it, so that no two pairs have one message."""
    name = F.encode(namespace, "UTF-8")
    size = F.unhex(F.lpad(F.hex(F.octet_length(name).cast("long")), 4, "0"))
    return hmac_sha256(F.concat(size, name, F.encode(normalized, "UTF-8")), key)


def digest_index(entries: DataFrame, key: bytes) -> DataFrame:
    """entry_id and digest of every identifier: an index that can be searched without holding a value."""
    ids = exploded_identifiers(entries)
    return ids.select("entry_id", keyed_digest(F.col("namespace"), F.col("normalized"), key).alias("digest")).distinct()


def structured_by_digest(index: DataFrame, namespaces: list[str], query: str, key: bytes) -> DataFrame:
    """entry_id of entries with an identifier equal to the query in one of the namespaces, from digests alone."""
    wanted = normalize_query(query).encode()
    digests = [hmac.new(key, len(n.encode()).to_bytes(2, "big") + n.encode() + wanted, "sha256").hexdigest() for n in namespaces]
    return index.where(F.col("digest").isin(*digests)).select("entry_id").distinct()


def structured(entries: DataFrame, query: str, namespace: str | None = None) -> DataFrame:
    """entry_id of entries with an identifier equal to the normalised query, of one namespace if one is given."""
    wanted = normalize_query(query)
    own = lambda i: i["normalized"] == wanted if namespace is None else (i["normalized"] == wanted) & (i["namespace"] == namespace)
    return entries.where(F.exists("identifiers", own)).select("entry_id").distinct()


def literal(entries: DataFrame, query: str, found: DataFrame) -> DataFrame:
    """entry_id of entries without a structured match whose text holds the query as typed, case folded."""
    rest = entries.join(found.select("entry_id"), "entry_id", "left_anti")
    return rest.where(F.contains(casefold(F.col("text")), F.lit(query.casefold()))).select("entry_id").distinct()


def search(entries: DataFrame, query: str, expansion: DataFrame | None = None) -> DataFrame:
    """entry_id and reasons (in fixed order) of all entries found, ordered by entry_id.

    `expansion` holds (entry_id, reason) of entries reached through links.
    """
    by_id = structured(entries, query)
    found = by_id.withColumn("reason", F.lit(STRUCTURED)).unionByName(literal(entries, query, by_id).withColumn("reason", F.lit(LITERAL)))
    if expansion is not None:
        found = found.unionByName(expansion.select("entry_id", "reason"))
    place = F.create_map(*[F.lit(x) for pair in ((STRUCTURED, 0), (LITERAL, 1), (EXPANDED, 2), (EVIDENCE, 3)) for x in pair])
    reasons = F.transform(F.array_sort(F.collect_set(F.struct(place[F.col("reason")].alias("p"), "reason"))), lambda x: x["reason"])
    return found.groupBy("entry_id").agg(reasons.alias("reasons")).orderBy("entry_id")


def selected(entries: DataFrame, query: str, expansion: DataFrame | None = None) -> DataFrame:
    """The entries that search() finds, with their reasons. Whether an entry holds the query is told row by row, so only the
    ids of `expansion` are joined, and only texts that lower() can't fold go to Python."""
    wanted, needle, t = normalize_query(query), F.lit(query.casefold()), F.col("text")
    holds = F.coalesce(F.exists("identifiers", lambda i: i["normalized"] == wanted), F.lit(False))
    none = F.array().cast("array<string>")
    if expansion is None:
        told = entries.withColumn("__linked", none)
    else:
        reached = materialize(expansion.groupBy("entry_id").agg(F.collect_set("reason").alias("__linked")))
        told = entries.join(reached, "entry_id", "left").withColumn("__linked", F.coalesce("__linked", none))
    maybe = told.where(holds | F.contains(F.lower(t), needle) | (F.octet_length(t) != F.char_length(t)) | (F.size("__linked") > 0))
    own = F.when(holds, STRUCTURED).when(F.contains(casefold(t), needle), LITERAL)
    reasons = F.array_compact(F.array(own, *[F.when(F.array_contains("__linked", r), r) for r in (EXPANDED, EVIDENCE)]))
    return maybe.withColumn("reasons", reasons).where(F.size("reasons") > 0).drop("__linked")


def expand(identifiers: DataFrame, query: str, reach: DataFrame, edges: DataFrame) -> DataFrame:
    """(entry_id, reason) reached from nodes that equal the query: entries of the nodes reached, and entries that
    declare an edge of a path, which runs either way."""
    wanted = normalize_query(query)
    node = F.concat_ws("\u0000", "namespace", "normalized")
    ids = identifiers.select("entry_id", node.alias("node"), "normalized")
    seeds = ids.where(F.col("normalized") == wanted).select(F.col("node").alias("source")).distinct()
    ends = reach.join(seeds, "source", "left_semi")
    reached = ends.select("node").join(ids, "node").select("entry_id").distinct().withColumn("reason", F.lit(EXPANDED))
    # every node reached has the step from its parent: together these are the steps of all paths
    steps = ends.where("depth > 0").select(F.col("parent").alias("src"), F.col("node").alias("dst")).distinct()
    both = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    on_path = edges.join(both, ["src", "dst"], "left_semi")
    return reached.unionByName(on_path.select("entry_id").distinct().withColumn("reason", F.lit(EVIDENCE)))
