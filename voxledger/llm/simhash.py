"""Operator 6: near duplicates by SimHash, found with the generalised pigeonhole principle.

Fingerprint: XXH64 (seed 42) of every 3-word shingle of the lower-cased text; a bit is 1 if it is set
in more than half of the hashes. Two fingerprints link at `tau` or fewer differing bits.

Search: the 64 bits are dealt into groups, correlated bits together. If two fingerprints differ in at
most tau bits and group i gets a threshold t_i with sum(t_i) = tau - groups + 1, then some group i
differs in at most t_i bits. Thresholds (and the number of groups) come from a dynamic program over
estimated costs: signature rows written plus candidate pairs compared. A group with threshold t
yields one mask for each way to ignore t of its bits (threshold -1: none), and two fingerprints are
candidates if they agree under a mask. Each bucket of equal signatures is verified with XOR and
popcount inside its task, which returns only a spanning forest of the bucket's links, never its pairs.
A bucket over `bucket_rows` is cut into blocks and every pair of blocks is a bucket of its own, so the
search stays exact whatever the skew.

Nulls and empty texts have fingerprint zero and link like any other. Rows with equal fingerprints are
one node, so thousands of copies cost one signature. Rows that repeat a doc_id are scored one by one.
A null doc_id counts for no component id unless a component has no other. An empty table gives an empty one.
Other columns, whatever their names, are left alone: keep_one() returns the columns of docs. Texts of any
length are hashed whole, some megabytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from .common import materialize, packed, read_table, scratch, words_in_chunks

TAU = 3
#: Distinct fingerprints from which bit correlations and candidate counts are estimated.
FIT_ROWS = 20_000
#: Most rows of a bucket that one task compares; larger buckets are compared block by block.
BUCKET_ROWS = 4096


def _bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit (little-endian order): bytes are added 8 at a time as
    uint64 lanes, at most 255 rows before the lanes are widened."""
    n = len(hashes)
    rows = -(-n // 255) * 255
    padded = np.zeros(rows, np.uint64)
    padded[:n] = hashes
    lanes = np.unpackbits(padded.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 255, 8)
    return lanes.sum(axis=1).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(data: bytes | None) -> int:
    """The unsigned fingerprint of a text's UTF-8 bytes. bytes.lower() lowers A-Z alone."""
    if not data:
        return 0
    total, counts, carry = 0, np.zeros(64, np.int64), []
    digest = xxhash.xxh64_intdigest
    for part in words_in_chunks(data.lower()):
        words = carry + part
        if len(words) < 3:
            carry = words
            continue
        joined = b" ".join(words)
        ends = list(accumulate(map(len, words)))
        spans = zip([0, *(e + i for i, e in enumerate(ends[:-3], 1))], [e + i for i, e in enumerate(ends[2:], 2)], strict=True)
        hashes = [digest(joined[a:b], 42) for a, b in spans]
        counts += _bit_counts(hashes)
        total += len(hashes)
        carry = words[-2:]
    if not total:
        return digest(b" ".join(carry), 42) if carry else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


@arrow_udf(T.LongType())
def fingerprint_udf(text: pa.Array) -> pa.Array:
    return pa.array(np.fromiter(map(fingerprint, text.to_pylist()), np.uint64, len(text)).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (signed long) and a hash of the text of every row."""
    return docs.select("doc_id", fingerprint_udf(F.col("text").cast("binary")).alias("fp"), F.xxhash64("text").alias("text_hash"))


# ---------------------------------------------------------------- plan of the search


def group_bits(bits: np.ndarray, groups: int) -> list[list[int]]:
    """Deal the 64 columns of `bits` (rows of 0/1) into `groups` of nearly equal width: each group
    starts from the most correlated free pair and takes the bit most correlated with it until full."""
    x = bits - bits.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0)) + 1e-9
    corr = np.abs(x.T @ x / np.outer(norm, norm))
    np.fill_diagonal(corr, -1)
    free, out = set(range(64)), []
    for g in range(groups):
        width = 64 // groups + (g < 64 % groups)
        live = np.array(sorted(free))
        own = [int(live[np.unravel_index(np.argmax(corr[np.ix_(live, live)]), (len(live),) * 2)[0]])]
        free.discard(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda b: corr[b, own].mean())
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def _agreement(sample: np.ndarray, masks: list[int]) -> float:
    """Estimated share of pairs of rows that agree under some mask: observed in the sample, and never
    under the share that independent even bits would give."""
    n, share = len(sample), 0.0
    for m in masks:
        _, c = np.unique(sample & np.uint64(m), return_counts=True)
        seen = float((c.astype(float) * (c - 1)).sum()) / max(1, n * (n - 1))
        share += max(seen, 2.0 ** -bin(m).count("1"))
    return share


def choose_masks(sample: np.ndarray, rows: int, tau: int = TAU, row_cost: float = 40.0) -> list[int]:
    """The signature masks of least estimated cost for `rows` distinct fingerprints.

    For 2 to tau + 1 groups, a dynamic program picks thresholds with sum tau - groups + 1; a signature
    row costs as much as `row_cost` compared pairs.
    """
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    best: tuple[float, list[int]] | None = None
    for groups in range(2, tau + 2):
        parts, want = group_bits(bits, groups), tau - groups + 1
        options: list[list[tuple[int, float, list[int]]]] = []
        for part in parts:
            full, own = sum(1 << b for b in part), [(-1, 0.0, [])]
            for t in range(0, min(2, want + groups - 1) + 1):
                masks = [full - sum(1 << b for b in drop) for drop in combinations(part, t)]
                probe = masks if len(masks) <= 64 else masks[:: len(masks) // 64]
                pairs = _agreement(sample, probe) * len(masks) / len(probe) * rows * max(0, rows - 1) / 2
                own.append((t, rows * len(masks) * row_cost + pairs, masks))
            options.append(own)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for own in options:  # state: sum of thresholds so far
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, masks) in table.items():
                for t, more, added in own:
                    if s + t not in step or cost + more < step[s + t][0]:
                        step[s + t] = (cost + more, masks + added)
            table = step
        if want in table and (best is None or table[want][0] < best[0]):
            best = table[want]
    assert best is not None
    return best[1]


# ---------------------------------------------------------------- probe and verify


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The roots of rows `at`, however far up; the paths to them are shortened on the way."""
    while not np.array_equal(up := parent[at], at):
        parent[at] = at = parent[up]
    return at


def forest(group: np.ndarray, fp: np.ndarray, tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest: rows are sorted by `group`, and rows of one group link at `tau` or
    fewer differing bits. Returns (member, root) row numbers."""
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    end = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    parent = np.arange(n)
    alive, k = np.arange(n), 1
    while len(alive := alive[end[alive] > alive + k]):
        near = alive[np.bitwise_count(fp[alive] ^ fp[alive + k]) <= tau]
        a, b = near, near + k
        while len(a):
            a, b = _roots(parent, a), _roots(parent, b)
            differ = a != b
            a, b = a[differ], b[differ]
            if len(a):
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        k += 1
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    member = np.flatnonzero(parent != np.arange(n))
    return member, parent[member]


def _links(tau: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches arrive sorted by bucket; the bucket that a batch ends in waits for the next one."""
        held: list[np.ndarray] = []

        def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            *keys, fp = cols
            change = np.zeros(len(fp), bool)
            for c in keys:
                change[1:] |= c[1:] != c[:-1]
            member, root = forest(np.cumsum(change), fp.view(np.uint64), tau)
            if len(member):
                yield pa.RecordBatch.from_arrays([pa.array(fp[member]), pa.array(fp[root])], schema=schema)

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
            if not len(cols[0]):
                continue
            last = np.ones(len(cols[0]), bool)
            for c in cols[:-1]:
                last &= c == c[-1]
            cut = int(np.argmax(last))
            if cut:
                yield from emit([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held:
            yield from emit(held)

    return run


def links(nodes: DataFrame, tau: int = TAU, fit_rows: int = FIT_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A set of links (src, dst) between distinct fingerprints `nodes(fp)` that connects exactly the
    fingerprints connected by all links."""
    rows = nodes.count()
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(fit_rows).select("fp").collect()], np.int64).view(np.uint64)
    if rows < 2:
        return nodes.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0)
    masks = [m - (1 << 64) if m >> 63 else m for m in choose_masks(sample, rows, tau)]
    signed = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("sig", "key")
    signatures = nodes.select("fp", signed)
    crowded = signatures.groupBy("sig", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    crowded = materialize(crowded)
    blocks = signatures.withColumns({"i": F.lit(0), "j": F.lit(0)})
    if not crowded.isEmpty():
        own = F.pmod(F.xxhash64("fp", "sig"), F.col("b")).cast("int")
        other = F.explode(F.sequence(F.lit(0), (F.col("b") - 1).cast("int")))
        cut = crowded.select("sig", "key", F.ceil(F.col("n") * 2 / bucket_rows).cast("long").alias("b"))
        in_blocks = signatures.join(cut, ["sig", "key"]).select("fp", "sig", "key", own.alias("o"), other.alias("p"))
        in_blocks = in_blocks.select("fp", "sig", "key", F.least("o", "p").alias("i"), F.greatest("o", "p").alias("j"))
        blocks = blocks.join(crowded, ["sig", "key"], "left_anti").unionByName(in_blocks)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["sig", "key", "i", "j"]
    dealt = blocks.select(*by, "fp").repartition(n, *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(_links(tau), "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges(src, dst)` that isn't its own root.

    Each round every node hooks to its least neighbour, hooks are followed to their ends by pointer
    jumping, and the edges are rewritten between the ends; a round at least halves what is unmerged.
    Each step is written to the shared folder.
    """
    rest = materialize(edges.where(F.col("src") != F.col("dst")).distinct())
    roots: DataFrame | None = None
    while not rest.isEmpty():
        both = rest.union(rest.select("dst", "src"))
        hook = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"))
        hook = materialize(hook.select("node", F.least("node", "low").alias("root")).where(F.col("node") != F.col("root")))
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = hook.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
            jumped = materialize(jumped)
            moved = not jumped.where("moved").isEmpty()
            hook = jumped.drop("moved")
            if not moved:
                break
        if roots is None:
            roots = hook
        else:
            later = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = roots.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            roots = materialize(roots.unionByName(hook))
        a = hook.select(F.col("node").alias("src"), F.col("root").alias("a"))
        b = hook.select(F.col("node").alias("dst"), F.col("root").alias("b"))
        new = rest.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
        rest = materialize(new.where(F.col("src") != F.col("dst")).distinct())
    return roots if roots is not None else rest.select(F.col("src").alias("node"), F.col("dst").alias("root"))


def near_duplicates(docs: DataFrame, tau: int = TAU, fit_rows: int = FIT_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fp, text_hash, component_id (the least doc_id of the component) and root (its least
    fingerprint, so one for each component) of every row of docs."""
    with scratch(docs.sparkSession) as keep:
        rows = materialize(fingerprints(docs))
        nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
        roots = components(links(nodes.select("fp"), tau, fit_rows, bucket_rows))
        rooted = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
        rooted = materialize(rooted)
        low = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")))
        return keep(rows.join(materialize(rooted.join(low, "root").select("fp", "component_id", "root")), "fp"))


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each component one row stays, one with the least doc_id (null only if the
    component has no other) and of those the least hash of the text. A doc_id, or null, whose rows are in
    several components has a row for each. Columns are unchanged.

    Texts are shuffled once, to meet the keys of the rows that stay: a sort-merge join at every size, since
    these keys grow with the corpus.
    """
    with scratch(docs.sparkSession) as keep:
        found = near_duplicates(docs)
        first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        first = first.groupBy("root").agg(F.min("doc_id").alias("id"), F.min("text_hash").alias("hash"), F.count(F.lit(1)).alias("n"))
        first = keep(first.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"), "hash", "n"))
    rows = docs.select(packed(docs), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("hash"))

    def rows_of(kept: DataFrame) -> DataFrame:
        return rows.join(kept.hint("merge"), ["id", "none", "hash"], "left_semi")

    repeated = first.where("n > 1")
    if repeated.isEmpty():
        return rows_of(first).select("row.*")
    # what is left of a component that had several rows is equal in doc_id and text
    again = rows_of(repeated).withColumn("text", F.col("row.text")).dropDuplicates(["id", "none", "text"])
    return rows_of(first.where("n = 1")).select("row.*").unionByName(again.select("row.*"))
