"""Operator 2: benchmark decontamination with suffix arrays over the training text.

Words: A-Z lowered, runs of letters, digits and non-ASCII characters. A window is WINDOW consecutive
words of an item; an item with fewer words, but not none, is one window. A document word inside any
occurrence of a window is hit; a document is contaminated if n_hit > 0 and 20 * n_hit >= n_words.

Method: each task cuts its documents into shards of about SHARD_WORDS words and builds a word suffix
array of each; every test suffix (cut to a window) is binary-searched in every shard, which gives the
locations of its verbatim matches. Matches that overlap or touch are joined to the longest ones. Words
that no item has end a suffix, and stretches between them that are shorter than the shortest window
can't hold a match, so those suffixes are left out of the array.

The items are taken in blocks of at most `block_words` words, longer items in pieces that overlap by a window less
one word; only one block is on the driver and sent to the executors at a time, so both stay within that bound
however large the benchmark is. Documents never leave their task: no shuffle.

Null and empty texts have no words and are not contaminated. Items without words are ignored. An item
without an id still hits words but is not counted among the items; rows of one item id are one item.
Repeated documents are judged one by one. A very long text is searched in stretches that overlap by a
window less one word. An empty table of documents gives no rows; without items nothing is contaminated. Other
columns, whatever their names, stay in the struct `row`; drop_contaminated() returns the columns of docs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from .common import materialize, packed, read_table, words_in_chunks

WINDOW = 13
SHARD_WORDS = 1 << 20
#: Words of benchmark items that are searched at once: the bound on what is broadcast.
BLOCK_WORDS = 1 << 20

#: A-Z lowered; bytes 00-2F, 3A-60 and 7B-7F (after lowering) separate words.
SEPARATE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def item_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(SEPARATE).split()


@dataclass
class Block:
    """Some items' distinct windows: ids of their words by length, and which items have each."""

    vocabulary: dict[bytes, int]
    windows: list[tuple[np.ndarray, list[list[str]]]]  # one for each length: (windows x length), item ids
    shortest: int
    longest: int

    @classmethod
    def of(cls, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> Block:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words)
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(ids[i : i + window], set()).update([] if item is None else [item])
        lengths = sorted({len(w) for w in found})
        own = [sorted(w for w in found if len(w) == n) for n in lengths]
        return cls(vocabulary, [(np.array(ws, np.int64), [sorted(found[w]) for w in ws]) for ws in own], lengths[0], lengths[-1])


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of `tokens` in order of their first `depth` tokens. Ranks of the parts of
    two or three neighbours make the next key, so the sorted depth doubles or triples each round."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank, done = rank.astype(np.int64) + 1, 1
    while True:
        top = int(rank.max()) + 1
        parts = 3 if top < 2_000_000 else 2
        key = rank.copy()
        for k in range(1, parts):
            key *= top
            key[: max(0, n - k * done)] += rank[k * done :]
        order = np.argsort(key, kind="stable")
        done *= parts
        if done >= depth:
            return order
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[1, key[order][1:] != key[order][:-1]])
        if new.max() == n:
            return order
        rank = new


def search(tokens: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of `order` whose suffixes start with each row of `wanted`, by binary search of all rows at once."""
    n, length = len(order), wanted.shape[1]
    padded = np.r_[tokens, np.zeros(length, tokens.dtype)]
    step = np.arange(length)

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), n, np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            differ = padded[order[mid][:, None] + step] - wanted[open_]
            first = np.argmax(differ != 0, axis=1)
            sign = differ[np.arange(len(open_)), first]
            right = sign <= 0 if after else sign < 0
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low

    return bound(False), bound(True)


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end) in order, overlapping and touching ones joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.c_[spans[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]]


class _Shard:
    """Stretches of documents that may hold a match, and what the search finds in them."""

    def __init__(self, block: Block, limit: int):
        self.block, self.limit = block, limit
        self.parts: list[np.ndarray] = []
        self.places: list[tuple[int, int, int]] = []  # first token, document, word position
        self.size = 0
        self.spans: dict[int, list[np.ndarray]] = {}
        self.items: dict[int, set[str]] = {}

    def add(self, doc: int, at: int, ids: np.ndarray) -> None:
        known = np.flatnonzero(np.diff(np.r_[0, ids != 0, 0]))
        for a, b in known.reshape(-1, 2)[(known[1::2] - known[::2]) >= self.block.shortest]:
            self.places.append((self.size, doc, at + int(a)))
            self.parts += [ids[a:b], np.zeros(1, ids.dtype)]
            self.size += int(b - a) + 1
        if self.size >= self.limit:
            self.flush()

    def flush(self) -> None:
        if not self.size:
            return
        tokens = np.concatenate(self.parts).astype(np.int64)
        starts, docs, at = map(np.array, zip(*self.places, strict=True))
        order = suffix_array(tokens, self.block.longest)
        for wanted, items in self.block.windows:
            low, high = search(tokens, order, wanted)
            for w in np.flatnonzero(high > low):
                where = order[low[w] : high[w]]
                place = np.searchsorted(starts, where, "right") - 1
                first = at[place] + where - starts[place]
                by_doc = np.argsort(docs[place], kind="stable")
                own, cut = np.unique(docs[place][by_doc], return_index=True)
                for d, f in zip(own.tolist(), np.split(first[by_doc], cut[1:]), strict=True):
                    self.spans.setdefault(d, []).append(np.c_[f, f + wanted.shape[1]])
                    self.items.setdefault(d, set()).update(items[w])
        for d, spans in self.spans.items():
            self.spans[d] = [_joined(np.concatenate(spans))]
        self.parts, self.places, self.size = [], [], 0


def find_matches(texts: list[bytes | None], block: Block, shard_words: int = SHARD_WORDS) -> list[dict]:
    """n_words, spans (start, end in words) and items of each text."""
    shard, counts, get = _Shard(block, shard_words), [], block.vocabulary.get
    for doc, text in enumerate(texts):
        n, tail = 0, np.zeros(0, np.int32)
        for part in words_in_chunks((text or b"").translate(SEPARATE)):
            ids = np.fromiter((get(w, 0) for w in part), np.int32, len(part))
            shard.add(doc, n - len(tail), np.r_[tail, ids] if len(tail) else ids)
            n += len(part)
            tail = np.r_[tail, ids][-(block.longest - 1) :] if block.longest > 1 else tail
        counts.append(n)
    shard.flush()
    out = []
    for doc, n in enumerate(counts):
        spans = shard.spans.get(doc, [np.zeros((0, 2), np.int64)])[0]
        out.append({"n_words": n, "spans": [{"start": int(a), "end": int(b)} for a, b in spans], "items": sorted(shard.items.get(doc, ()))})
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
MATCHES = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _match_column(sent: Broadcast, text: Column) -> Column:
    @arrow_udf(MATCHES)
    def match(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in data:
            yield pa.array(find_matches(x.to_pylist(), sent.value), _ARROW)

    return match(text.cast("binary"))


def _blocks(items: DataFrame, block_words: int) -> Iterator[Block]:
    held: list[tuple[str | None, list[bytes]]] = []
    size, block_words = 0, max(block_words, 2 * WINDOW)
    for r in items.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        words, step = item_words(r[1] and bytes(r[1])), block_words - WINDOW + 1
        for at in range(0, len(words), step):
            if at and len(words) - at < WINDOW:
                break  # the piece before holds the last window
            piece = words[at : at + block_words]
            if held and size + len(piece) > block_words:
                yield Block.of(held)
                held, size = [], 0
            held.append((r[0], piece))
            size += len(piece)
    if held:
        yield Block.of(held)


@arrow_udf(SPANS)
def _join_spans(spans: pa.Array) -> pa.Array:
    out = [_joined(np.array([(s["start"], s["end"]) for s in x or ()], np.int64).reshape(-1, 2)) for x in spans.to_pylist()]
    return pa.array([[{"start": int(a), "end": int(b)} for a, b in x] for x in out], _ARROW.field("spans").type)


def _hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def contamination(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """row (the columns of docs) and match (n_words, spans, items) of every row: the longest verbatim matches
    of each document with their places, and the ids of the items with windows in it."""
    context, text = docs.sparkSession.sparkContext, F.col("text")
    key = [F.col("doc_id").alias("d"), F.xxhash64("text").alias("h")]
    # Matches of all blocks but the last are gathered by document and joined: equal rows have equal matches.
    last: Block | None = None
    more: DataFrame | None = None
    for block in _blocks(items, block_words):
        if last is not None:  # one block is sent at a time, and taken back when its matches are stored
            sent = context.broadcast(last)
            one = docs.select(*key, _match_column(sent, text).alias("m")).where(F.size("m.spans") > 0)
            one = materialize(one.select("d", "h", "m.spans", "m.items").dropDuplicates(["d", "h"]))
            sent.destroy()
            more = one if more is None else more.unionByName(one)
        last = block
    if last is None:
        return docs.select(packed(docs), F.struct(_count(text).alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items")).alias("match"))
    column = _match_column(context.broadcast(last), text)
    if more is None:
        return docs.select(packed(docs), column.alias("match"))
    more = more.groupBy(F.col("d").alias("d2"), F.col("h").alias("h2")).agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i"))
    base = docs.select(packed(docs), *key, column.alias("m"))
    both = base.join(materialize(more), F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left")
    m, s, i = F.col("m"), F.col("s"), F.col("i")
    full = F.when(s.isNull(), m).otherwise(F.struct(m["n_words"].alias("n_words"), _join_spans(F.concat(m["spans"], s)).alias("spans"), F.array_sort(F.array_union(m["items"], i)).alias("items")))
    return both.select("row", full.alias("match"))


def _count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def contaminated() -> Column:
    n = _hit(F.col("match.spans"))
    return (n > 0) & (20 * n >= F.col("match.n_words"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    longest = F.coalesce(F.array_max(F.transform("match.spans", lambda s: s["end"] - s["start"])), F.lit(0)).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("match.n_words").alias("n_words"),
        _hit(F.col("match.spans")).alias("n_hit"),
        F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("match.items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        longest.alias("longest_match"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline stage: documents that are not contaminated stay, columns unchanged."""
    return contamination(docs, items).where(~contaminated()).select("row.*")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM iw WHERE len(w) > 0)),
dpos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM dw WHERE len(w) > 0),
occ AS (
  SELECT p.doc_id, p.i, x.n, x.item_id
  FROM (SELECT DISTINCT n FROM win) l
  JOIN dpos p ON p.i + l.n - 1 <= len(p.w)
  JOIN win x ON x.n = l.n AND x.win = array_to_string(p.w[p.i : p.i + l.n - 1], ' ')),
hit AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM occ),
runs AS (SELECT doc_id, count(*) AS len FROM (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM hit) GROUP BY doc_id, run),
nh AS (SELECT doc_id, sum(len) AS n_hit, max(len) AS longest FROM runs GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
