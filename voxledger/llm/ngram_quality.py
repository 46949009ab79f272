"""Operator 3: quality by perplexity under an interpolated modified Kneser-Ney trigram model.

The model is trained on trusted text: documents whose labels all say quality 1. Trigram counts, continuation
counts and counts of counts are Spark aggregations; discounts D1, D2, D3+ follow from the counts of counts
of each order. p(w | u v) = a3(u v w) + g3(u v) * (a2(v w) + g2(v) * (a1(w) + g1 / (V + 1))).

One in HELD_OUT trusted documents, by the same hash of doc_id as in lm_scoring, is never trained on, and of two
or more at least one isn't. All others are trained on (`train_docs` may set a bound for trials). While the n-gram table has
at most `broadcast_rows` n-grams it is made, cut into SHARDS by key, and broadcast. Above that it is never made: the trigrams
of all documents, packed in blocks, are shuffled once by their middle word, and each bucket counts those of the training
documents and scores all (`score_by_exchange`). Very frequent middle words are cut further by the first word. Should the
training documents hold over VOCABULARY words, the table is made and joined (`score_by_join`). All documents are scored over
their whole texts.

Verdict: a document is kept while its mean surprisal, drawn towards its language's mean by PRIOR_WORDS
words, is within its language's limit: the language's mean plus the QUANTILE of the distances from it of the trusted
documents of the language that were not trained on. The fewer these n are, the more that quantile is drawn towards that
of all languages, by n to SHRINK: one rule at every size. Where fewer than two trusted documents have a text there may be no
threshold, and then all are kept.

Null and empty texts are one end token. A null lang is a language of its own. Repeated rows are scored one
by one and alike; labels without a document, and null labels, count for nothing. An empty table gives no rows.
Columns but doc_id, lang and text, whatever their names, are not read. Very long texts are hashed some megabytes at
a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from .common import materialize, read_table, scratch, words_in_chunks

SHARDS = 16
BROADCAST_ROWS = 4_000_000
QUANTILE = 0.995
HELD_OUT = 5
SHRINK = 200  # documents of a language that count as much as the quantile of all languages
PRIOR_WORDS = 50
SALTS = 8  # tasks that share one n-gram of the shuffle join
BLOCK_BYTES = 16 << 20  # texts whose trigrams are sent together
BUCKET_TOKENS = 3_000_000  # about as many tokens meet in a bucket of the exchange
SOME_DOCS = 5_000  # about as many tell how many buckets there are
VOCABULARY = 8_000_000  # training words that the exchange may broadcast
ZSTD = 9  # disk is dearer here than time
RANGE = 1 << 16  # words whose continuation counts are added together
BEGIN, END = 1, 2  # stand for sentence borders among word hashes
#: Odd multipliers that combine word hashes into n-gram keys.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class _Hashes(dict):
    """Words to 64-bit hashes, remembered while a batch lasts."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def sequences(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, each text led by two BEGIN and closed by END; and the texts' lengths."""
    get, out, lengths = _Hashes().__getitem__, [], []
    for text in texts:
        parts = [np.array([BEGIN, BEGIN], np.uint64)]
        for words in words_in_chunks((text or b"").lower()):
            parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
        parts.append(np.array([END], np.uint64))
        out += parts
        lengths.append(sum(map(len, parts)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(lengths, np.int64)


def key2(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return v * MIX[0] + w * MIX[1]


def key3(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return u * MIX[0] + v * MIX[1] + w * MIX[2]


# ---------------------------------------------------------------- training


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t, lengths = sequences(batch.column(0).to_pylist())
        ends = np.cumsum(lengths)
        last = np.ones(len(t), bool)
        for at in (0, 1):  # the two leading marks of a text end no trigram
            last[ends - lengths + at] = False
        w = np.flatnonzero(last)
        rows, n = np.unique(np.c_[t[w - 2], t[w - 1], t[w]].view(np.int64), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(3)), pa.array(n)], names=["u", "v", "w", "n"])


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times; plain values where some are none."""
    if not all(n.get(k) for k in (1, 2, 3, 4)):
        return 0.5, 0.75, 0.9
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(k - 0.01, max(0.01, k - (k + 1) * y * n[k + 1] / n[k])) for k in (1, 2, 3))  # type: ignore[return-value]


def _discounted(counts: DataFrame, history: list[str]) -> tuple[DataFrame, DataFrame, int, int, tuple[float, float, float]]:
    """a for each row of `counts` (c) and g for each history."""
    of = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    d = discounts(of)
    cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    sums = counts.groupBy(*history).agg(F.sum("c").alias("total"), F.sum(cut).alias("freed"), F.count(F.lit(1)).alias("types"))
    if history:
        each = counts.join(sums, history).withColumn("a", (F.col("c") - cut) / F.col("total"))
        return each, sums.withColumn("g", F.col("freed") / F.col("total")), 0, 0, d
    row = sums.first()
    each = counts.withColumn("a", (F.col("c") - cut) / F.lit(float(row["total"] or 1)))
    return each, sums, row["total"] or 0, row["types"], d


def chosen_ids(labels: DataFrame, train_docs: int | None = None) -> DataFrame:
    """The ids that are trained on."""
    trusted = materialize(trusted_ids(labels))
    rest = trusted.where(F.crc32(F.col("__id").cast("string").cast("binary")) % HELD_OUT != 1)
    known = rest.count()
    most = min(known if train_docs is None else train_docs, max(1, trusted.count() - 1))
    return materialize(rest if most >= known else rest.orderBy(F.xxhash64("__id"), "__id").limit(most))


def train(docs: DataFrame, labels: DataFrame, train_docs: int | None = None, chosen: DataFrame | None = None) -> tuple[DataFrame, float, DataFrame]:
    """The n-gram table (order, u, v, w, a, g), the chance of an unknown word, and the ids trained on."""
    chosen = chosen_ids(labels, train_docs) if chosen is None else chosen
    three = materialize(_trained_on(docs, chosen).mapInArrow(_trigrams, "u long, v long, w long, n long").groupBy("u", "v", "w").agg(F.sum("n").alias("c")))
    two = materialize(three.groupBy("v", "w").agg(F.when(F.col("v") == BEGIN, F.sum("c")).otherwise(F.count(F.lit(1))).alias("c")))
    one = materialize(two.groupBy("w").agg(F.count(F.lit(1)).alias("c")))
    a3, g3, *_ = _discounted(three, ["u", "v"])
    a2, g2, *_ = _discounted(two, ["v"])
    a1, _, total, types, d = _discounted(one, [])
    freed = one.agg(F.sum(F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2]))).first()[0]
    unknown = (freed / total if total else 1.0) / (types + 1)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
    rows3 = a3.select(F.lit(3).alias("order"), "u", "v", "w", "a", none.alias("g"))
    h2 = g3.select(F.col("u").alias("v"), F.col("v").alias("w"), "g")  # a history of two words is a bigram
    rows2 = a2.select("v", "w", "a").join(h2, ["v", "w"], "full").select(F.lit(2).alias("order"), zero.alias("u"), "v", "w", F.coalesce("a", F.lit(0.0)).alias("a"), "g")
    h1 = g2.select(F.col("v").alias("w"), "g")
    rows1 = a1.select("w", "a").join(h1, "w", "full").select(F.lit(1).alias("order"), zero.alias("u"), zero.alias("v"), "w", (F.coalesce("a", F.lit(0.0)) + unknown).alias("a"), "g")
    return materialize(rows3.unionByName(rows2).unionByName(rows1)), unknown, chosen


def trusted_ids(labels: DataFrame) -> DataFrame:
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__q"))
    return known.where("__q = 1").select("__id")


# ---------------------------------------------------------------- scoring


@dataclass
class Shards:
    """The n-gram table by order and shard: sorted keys with their a and g."""

    tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]
    unknown: float

    @classmethod
    def of(cls, table: DataFrame, unknown: float) -> Shards:
        """Collects the table order by order, so that the driver holds one order's rows beside the keys."""
        return cls([cls._order(table, k) for k in (1, 2, 3)], unknown)

    @staticmethod
    def _order(table: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        words = ("u", "v", "w")[3 - order :]
        got = table.where(F.col("order") == order).select(*words, "a", *(["g"] if order < 3 else [])).toArrow()
        parts = [got.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in words]
        keys = parts[0] if order == 1 else (key2 if order == 2 else key3)(*parts)
        a = got.column("a").to_numpy()
        g = got.column("g").fill_null(1.0).to_numpy() if order < 3 else np.ones(1)
        del got, parts
        out = []
        for s in range(SHARDS):
            here = np.flatnonzero(keys % np.uint64(SHARDS) == s)
            here = here[np.argsort(keys[here])]
            out.append((keys[here], a[here], g[here] if order < 3 else g))
        return out

    def find(self, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a and g of keys: what isn't in the table has a = 0 and g = 1."""
        distinct, back = np.unique(keys, return_inverse=True)
        a, g = np.zeros(len(distinct)), np.ones(len(distinct))
        shard = distinct % np.uint64(SHARDS)
        for s, (known, ka, kg) in enumerate(self.tables[order - 1]):
            own = np.flatnonzero(shard == s)
            if len(own) and len(known):
                at = np.minimum(np.searchsorted(known, distinct[own]), len(known) - 1)
                hit = known[at] == distinct[own]
                a[own[hit]] = ka[at[hit]]
                if order < 3:
                    g[own[hit]] = kg[at[hit]]
        return a[back], g[back]

    def surprisal(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of -ln p over each text's words and end, and how many there are."""
        t, lengths = sequences(texts)
        if not len(t):
            return np.zeros(0), np.zeros(0, np.int64)
        before = np.r_[np.uint64(BEGIN), t[:-1]]
        a1, g2 = self.find(1, t)
        a2, g3 = self.find(2, key2(before, t))
        a3, _ = self.find(3, key3(np.r_[np.uint64(BEGIN), before[:-1]], before, t))
        a1[a1 == 0] = self.unknown
        shift = lambda x: np.r_[1.0, x[:-1]]  # noqa: E731  of the history
        p = a3 + shift(g3) * (a2 + shift(g2) * a1)
        starts = np.cumsum(lengths) - lengths
        lead = np.r_[starts, starts + 1]
        p[lead] = 1.0
        return np.add.reduceat(-np.log(p), starts), lengths - 2


SCORE = T.StructType([T.StructField("nats", T.DoubleType()), T.StructField("n", T.LongType())])


def _score_column(spark: SparkSession, text: Column, shards: Shards) -> Column:
    sent = spark.sparkContext.broadcast(shards)

    @arrow_udf(SCORE)
    def score(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in data:
            nats, n = [], []
            for at in range(0, len(x), 1000):  # bounds what is held at once
                some = sent.value.surprisal(x.slice(at, 1000).to_pylist())
                nats.append(some[0])
                n.append(some[1])
            both = [np.concatenate(v) if v else np.zeros(0) for v in (nats, n)]
            yield pa.StructArray.from_arrays([pa.array(both[0], pa.float64()), pa.array(both[1].astype(np.int64))], names=["nats", "n"])

    return score(text.cast("binary"))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (row, u, v, w) of a block's documents with their counts."""
    for batch in batches:
        rows = batch.column(0).to_numpy()
        t, lengths = sequences(batch.column(1).to_pylist())
        ends = np.cumsum(lengths)
        real = np.ones(len(t), bool)
        real[ends - lengths] = real[ends - lengths + 1] = False
        w = np.flatnonzero(real)
        of = np.repeat(rows, lengths)[w]
        all_, n = np.unique(np.c_[of, t[w - 2].view(np.int64), t[w - 1].view(np.int64), t[w].view(np.int64)], axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([*(pa.array(all_[:, k]) for k in range(4)), pa.array(n)], names=["__row", "u", "v", "w", "n"])


def score_by_join(rows: DataFrame, table: DataFrame, unknown: float) -> DataFrame:
    """(__row, nats, n) of rows (__row, text) by shuffle joins with the n-gram table: for tables over the
    broadcast bound. Each n-gram is dealt to SALTS tasks by row, so that frequent words, and n-grams of a large
    group of copies, don't come into one."""
    salt = F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int").alias("__salt")
    grams = rows.select("__row", F.col("text").cast("binary")).mapInArrow(_keys, "__row long, u long, v long, w long, n long").select("*", salt)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of = lambda k: salted.where(F.col("order") == k)
    t3 = of(3).select("__salt", "u", "v", "w", F.col("a").alias("a3"))
    t2 = of(2).select("__salt", "v", "w", F.col("a").alias("a2"))
    h2 = of(2).where("g is not null").select("__salt", F.col("v").alias("u"), F.col("w").alias("v"), F.col("g").alias("g3"))
    t1 = of(1).select("__salt", "w", F.col("a").alias("a1"))
    h1 = of(1).where("g is not null").select("__salt", F.col("w").alias("v"), F.col("g").alias("g2"))
    all_ = grams
    for side, key in ((t3, ["u", "v", "w"]), (h2, ["u", "v"]), (t2, ["v", "w"]), (h1, ["v"]), (t1, ["w"])):
        all_ = all_.join(side, ["__salt", *key], "left")
    c = lambda x, y: F.coalesce(F.col(x), F.lit(y))
    p = c("a3", 0.0) + c("g3", 1.0) * (c("a2", 0.0) + c("g2", 1.0) * c("a1", unknown))
    return all_.groupBy("__row").agg(F.sum(-F.log(p) * F.col("n")).alias("nats"), F.sum("n").alias("n"))


# ---------------------------------------------------------------- exchange by the middle word


@dataclass
class Codes:
    """Numbers of the training documents' words, the frequent ones first, and the bucket that a trigram goes to. All other words
    are number 0: in the model they are alike."""

    words: np.ndarray  # sorted hashes
    numbers: np.ndarray  # of them, from 3; BEGIN and END are numbers themselves
    heavy: np.ndarray  # sorted numbers of words so frequent that their trigrams are dealt to several buckets by the first word
    spread: np.ndarray  # to how many
    buckets: int

    def of(self, t: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.where(t <= END, t, 0).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.words, t), len(self.words) - 1)
        return np.where(t <= END, t, np.where(self.words[at] == t, self.numbers[at], 0)).astype(np.uint32)

    def bucket(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = _mixed(v) % np.uint64(self.buckets)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, v), len(self.heavy) - 1)
            many = np.flatnonzero(self.heavy[at] == v)
            out[many] = (out[many] + _mixed(u[many]) % self.spread[at[many]]) % np.uint64(self.buckets)
        return out.astype(np.int32)

    def buckets_of(self, v: int) -> list[int]:
        """All buckets that hold trigrams of a heavy word."""
        first = int(_mixed(np.array([v], np.uint64))[0] % np.uint64(self.buckets))
        return [(first + k) % self.buckets for k in range(int(self.spread[np.searchsorted(self.heavy, v)]))]


def _mixed(x: np.ndarray) -> np.ndarray:
    key = (x.astype(np.uint64) + np.uint64(1)) * MIX[0]
    return (key ^ key >> np.uint64(29)) * MIX[2] >> np.uint64(32)


def _pack(a: np.ndarray, width: int) -> bytes:
    """Numbers of `width` bytes, byte by byte of all of them, since the high ones are alike."""
    return pa.Codec("zstd", ZSTD).compress(a.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes(), asbytes=True)


def _unpack(data: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u4").ravel()


def _steps(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted v, from 1, and u within each, as differences from the row before."""
    dv = np.diff(v, prepend=np.uint32(0))
    return dv, np.where(dv > 0, u, u - np.r_[u[:1], u[:-1]])


def _stepped(dv: np.ndarray, du: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, sums = np.flatnonzero(dv), np.cumsum(du, dtype=np.int64)
    before = np.repeat(sums[starts] - du[starts], np.diff(np.r_[starts, len(dv)]))
    return np.cumsum(dv, dtype=np.uint32), (sums - before).astype(np.uint32)


def _pack_nats(x: np.ndarray) -> bytes:
    """Nats to a half of 2^-36; of a document in a bucket they are below 2^27."""
    whole = np.rint(x * 2.0**36).astype("<u8")
    return pa.compress(whole.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpack_nats(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, 8 * n, codec="zstd", asbytes=True) if n else b""
    planes = np.frombuffer(raw, np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel() / 2.0**36


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


PARTS = T.StructType([T.StructField(k, T.LongType()) for k in ("bucket", "block", "size", "docs")] + [T.StructField(k, T.BinaryType()) for k in ("v", "u", "w", "n", "doc", "own", "meta")])


def _part(**of: object) -> pa.RecordBatch:
    types = {f.name: pa.int64() if f.dataType == T.LongType() else pa.binary() for f in PARTS}
    return pa.RecordBatch.from_arrays([pa.array([of.get(k)], t) for k, t in types.items()], names=list(types))


def _parts(codes: Codes, block: int, texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
    """A block's distinct trigrams with their counts, a row for each bucket."""
    yield from _cut_up(codes, block, *_numbered(codes, texts)[:3], None)


def _parts_of_documents(codes: Codes, model: Model, block: int, texts: list[bytes | None], own: np.ndarray, docs: pa.Table) -> Iterator[pa.RecordBatch]:
    """A block's distinct trigrams of documents with their counts, a row for each bucket, and one of `docs` with their numbers
    of tokens and the nats of the tokens after an unknown word, which no history bears on."""
    u, v, w, doc, lengths = _numbered(codes, texts)
    lone = v == 0
    nats = np.bincount(doc[lone], -np.log(model.last(w[lone])), len(lengths)).astype(float)  # long where none are
    sink = pa.BufferOutputStream()
    docs = docs.append_column("nats", pa.array(nats)).append_column("n", pa.array(lengths - 2))
    with pa.ipc.new_stream(sink, docs.schema) as out:
        out.write_table(docs)
    yield _part(bucket=-1 - block, block=block, meta=sink.getvalue().to_pybytes())
    flags = {"docs": len(lengths), "own": pa.compress(np.packbits(own).tobytes(), codec="zstd", asbytes=True)}
    yield from _cut_up(codes, block, *(x[~lone] for x in (u, v, w, doc)), **flags)


def _numbered(codes: Codes, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """u, v, w and the document of each token of the texts, and the texts' lengths."""
    t, lengths = sequences(texts)
    distinct, back = np.unique(t, return_inverse=True)
    t = codes.of(distinct)[back]
    ends = np.cumsum(lengths)
    last = np.ones(len(t), bool)
    last[ends - lengths] = last[ends - lengths + 1] = False
    at = np.flatnonzero(last)
    return t[at - 2], t[at - 1], t[at], np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)[at], lengths


def _cut_up(codes: Codes, block: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, doc: np.ndarray | None, **more: object) -> Iterator[pa.RecordBatch]:
    bucket = codes.bucket(u, v)
    order = np.lexsort((w, u, v, bucket))  # stable: documents ascend
    columns = [x[order] for x in (bucket, v, u, w, *([] if doc is None else [doc]))]
    new = _new(*columns)
    n = np.diff(np.r_[new, len(u)])
    bucket, *columns = (x[new] for x in columns)
    cuts = np.r_[_new(bucket), len(bucket)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        v, u, *others = (x[a:b] for x in columns)
        packed = {k: _pack(x, 3) for k, x in zip(("v", "u", "w", "doc"), (*_steps(v, u), *others), strict=False)}
        yield _part(bucket=int(bucket[a]), block=block, size=int(b - a), n=_pack(n[a:b], 4), **packed, **more)


def _send(sent: Broadcast, model: Broadcast | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of texts as parts; for scoring, with a model, those of documents (doc_id, lang, text, own)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in enumerate(_filled(batches)):
            block, texts = (TaskContext.get().partitionId() << 32) + k, rows.column("text").to_pylist()
            if model is None:
                yield from _parts(sent.value, block, texts)
            else:
                own = rows.column("own").to_numpy()
                yield from _parts_of_documents(sent.value, model.value, block, texts, own, rows.select(["doc_id", "lang"]))

    return send


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, some BLOCK_BYTES of texts at a time."""
    held, size = [], 0
    for batch in batches:
        ends, done = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64)), 0
        while done < len(ends):
            before = int(ends[done - 1]) if done else 0
            to = max(int(np.searchsorted(ends, BLOCK_BYTES - size + before, "right")), done + (not held))
            if to > done:
                held.append(batch.slice(done, to - done))
                size, done = size + int(ends[to - 1]) - before, to
            if done < len(ends):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


@dataclass
class Bucket:
    """The distinct trigrams of a bucket, sorted by v, u, w."""

    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray  # the training count of each
    of: np.ndarray  # the trigram of each row of the parts, in their order

    @classmethod
    def of_parts(cls, parts: list[dict]) -> Bucket:
        words = [(*_stepped(*(_unpack(p[k], 3, p["size"]) for k in ("v", "u"))), _unpack(p["w"], 3, p["size"])) for p in parts]
        v, u, w = (np.concatenate(x) for x in zip(*words, strict=True))
        c = np.concatenate([_unpack(p["n"], 4, p["size"]) * _trained(p) for p in parts]).astype(np.int64)
        order = np.lexsort((w, u, v))
        v, u, w = v[order], u[order], w[order]
        new = _new(v, u, w)
        of = np.empty(len(order), np.int32)
        of[order] = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(np.r_[new, len(v)]))
        return cls(v[new], u[new], w[new], np.add.reduceat(c[order], new), of)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """v, w and continuation count of the distinct bigrams, and each trigram's bigram."""
        order = np.lexsort((self.w, self.v))
        v, w, c = self.v[order], self.w[order], self.c[order]
        new = _new(v, w)
        each = np.empty(len(order), np.int64)
        each[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(v)]))
        return v[new], w[new], np.add.reduceat(np.where(v == BEGIN, c, c > 0), new), each


def _trained(part: dict) -> np.ndarray | int:
    """1 for rows of training documents, 0 for others."""
    if part["own"] is None:
        return 1
    bits = np.frombuffer(pa.decompress(part["own"], -(-part["docs"] // 8), codec="zstd", asbytes=True), np.uint8)
    return np.unpackbits(bits)[_unpack(part["doc"], 3, part["size"])].astype(np.uint32)


COUNTS = "kind long, a long, n long, words binary, ends binary"


def _counts(sent: Broadcast) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket's training trigrams: counts of counts of trigrams (kind 3) and bigrams (2), how many bigrams end with each of
    the words from a * RANGE on (1), and each heavy word's bigrams with their counts (0), of which other buckets have more."""

    def counts(parts: pa.Table) -> pa.Table:
        bucket = Bucket.of_parts(parts.to_pylist())
        v, w, c2, _ = bucket.bigrams()
        heavy = np.isin(v, sent.value.heavy)
        out = [(3, k, int(np.sum(bucket.c == k)), None, None) for k in range(1, 5)] + _of_bigrams(w[~heavy], c2[~heavy])
        for x in np.unique(v[heavy]):
            a, b = np.searchsorted(v, [x, x + 1])
            out.append((0, int(x), int(b - a), _pack(w[a:b], 3), _pack(c2[a:b], 4)))
        return _count_rows(out)

    return counts


def _of_bigrams(w: np.ndarray, c2: np.ndarray) -> list[tuple]:
    few = [(2, k, int(np.sum(c2 == k)), None, None) for k in range(1, 5)]
    return few + [(1, k, RANGE, None, _pack(ends, 4)) for k, ends in _ranges(w)]


def _whole(parts: pa.Table) -> pa.Table:
    """The bigrams of a heavy word over all its buckets, and what kinds 1 and 2 hold of them."""
    rows = parts.to_pylist()
    w, back = np.unique(np.concatenate([_unpack(r["words"], 3, r["n"]) for r in rows]), return_inverse=True)
    c2 = np.bincount(back, np.concatenate([_unpack(r["ends"], 4, r["n"]) for r in rows])).astype(np.int64)
    return _count_rows([(0, rows[0]["a"], len(w), _pack(w, 3), _pack(c2, 4)), *_of_bigrams(w, c2)])


def _ranges(w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """How often each number is among w, RANGE numbers at a time."""
    w = np.sort(w)
    for k in np.unique(w // RANGE):
        a, b = np.searchsorted(w, [k * RANGE, (k + 1) * RANGE])
        yield int(k), np.bincount(w[a:b] - k * RANGE, minlength=RANGE)


def _count_rows(rows: list[tuple]) -> pa.Table:
    names = [f.split()[0] for f in COUNTS.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.binary()) for k in range(5)], names=names)


def _added(parts: pa.Table) -> pa.Table:
    """The sum of the ends of a range over all buckets."""
    return _count_rows([(1, parts.column("a")[0].as_py(), RANGE, None, _pack(sum(_unpack(x, 4, RANGE).astype(np.int64) for x in parts.column("ends").to_pylist()), 4))])


def _copies(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Heavy words' bigrams for each bucket that holds trigrams of theirs: parts without u, with v in the place of the block."""

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for bucket in sent.value.buckets_of(r["a"]):
                    yield _part(bucket=bucket, block=r["a"], size=r["n"], w=r["words"], n=r["ends"])

    return copies


@dataclass
class Model:
    """What a bucket can't tell from its own trigrams: discounts and words' continuation counts."""

    d3: tuple[float, float, float]
    d2: tuple[float, float, float]
    d1: tuple[float, float, float]
    ends: np.ndarray  # by the word's number
    total: int
    unknown: float

    @classmethod
    def of(cls, counts: DataFrame, words: int) -> Model:
        of3, of2 = ({r["a"]: r["n"] for r in counts.where(f"kind = {k}").collect()} for k in (3, 2))
        ends = np.zeros((words + 3 + RANGE - 1) // RANGE * RANGE, np.int64)
        for r in counts.where("kind = 1").select("a", "ends").toLocalIterator():
            ends[r["a"] * RANGE : (r["a"] + 1) * RANGE] = _unpack(r["ends"], 4, RANGE)
        d1 = discounts({k: int(np.sum(ends == k)) for k in range(1, 5)})
        total = int(ends.sum())
        unknown = (float(_cut(ends, d1).sum()) / total if total else 1.0) / (int(np.sum(ends > 0)) + 1)
        return cls(discounts(of3), discounts(of2), d1, ends.astype(np.uint32), total, unknown)

    def last(self, w: np.ndarray) -> np.ndarray:
        """The chance of a word whatever is before it."""
        c1 = self.ends[w]
        return (c1 - _cut(c1, self.d1)) / max(1, self.total) + self.unknown

    def nats(self, bucket: Bucket, heavy: list[dict]) -> np.ndarray:
        """-ln p of each trigram of a bucket, which holds all bigrams of its words but of `heavy` ones, told here."""
        v, w, c2, each = bucket.bigrams()
        c2, total, freed = self._bigrams(v, w, c2, heavy)
        a2, g2 = _shares(c2 - _cut(c2, self.d2), freed, total)
        low = (a2 + g2 * self.last(w))[each]
        new = _new(bucket.v, bucket.u)
        cut = _cut(bucket.c, self.d3)
        total, freed = (np.repeat(np.add.reduceat(x, new), np.diff(np.r_[new, len(cut)])) for x in (bucket.c, cut))
        a3, g3 = _shares(bucket.c - cut, freed, total)
        return -np.log(a3 + g3 * low)

    def _bigrams(self, v: np.ndarray, w: np.ndarray, c2: np.ndarray, heavy: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bigrams' counts over all buckets, and for each the sum of v's counts and of what is cut from them."""
        new = _new(v)
        width = np.diff(np.r_[new, len(v)])
        total, freed = (np.add.reduceat(x, new).astype(float) for x in (c2, _cut(c2, self.d2)))
        for p in heavy:
            words, counts = _unpack(p["w"], 3, p["size"]), _unpack(p["n"], 4, p["size"]).astype(np.int64)
            a, b = np.searchsorted(v, [p["block"], p["block"] + 1])
            if a < b:
                at = np.minimum(np.searchsorted(words, w[a:b]), len(words) - 1)
                c2[a:b] = np.where(words[at] == w[a:b], counts[at], 0)
                k = np.searchsorted(new, a)
                total[k], freed[k] = counts.sum(), _cut(counts, self.d2).sum()
        return c2, np.repeat(total, width), np.repeat(freed, width)


def _cut(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def _shares(left: np.ndarray, freed: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and g; 0 and 1 where a history isn't known."""
    seen = total > 0
    return np.divide(left, total, out=np.zeros(len(left)), where=seen), np.divide(freed, total, out=np.ones(len(left)), where=seen)


def _scores(model: Broadcast) -> Callable[[pa.Table], pa.Table]:
    """(block, bucket, nats of the block's documents in this bucket, meta)"""

    def scores(parts: pa.Table) -> pa.Table:
        rows = sorted(parts.to_pylist(), key=lambda p: p["block"])
        heavy, rows = [p for p in rows if p["meta"] is None and p["u"] is None], [p for p in rows if p["meta"] is not None or p["u"] is not None]
        got = []
        if rows and rows[0]["meta"] is not None:
            got = [(p["block"], p["bucket"], None, p["meta"]) for p in rows]
        elif rows:
            bucket, at = Bucket.of_parts(rows), 0
            nats = model.value.nats(bucket, heavy)
            for p in rows:
                here, at = bucket.of[at : at + p["size"]], at + p["size"]
                sums = np.bincount(_unpack(p["doc"], 3, p["size"]), nats[here] * _unpack(p["n"], 4, p["size"]), p["docs"])
                got.append((p["block"], p["bucket"], _pack_nats(sums), None))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in got], t) for k, t in enumerate(types)], names=["block", "bucket", "nats", "meta"])

    return scores


def _sums(parts: pa.Table) -> pa.Table:
    """doc_id, lang, nats, n of a block's documents."""
    rows = sorted(parts.to_pylist(), key=lambda p: p["bucket"])
    docs = pa.ipc.open_stream(rows[0]["meta"]).read_all()
    nats = docs.column("nats").to_numpy().copy()
    for p in rows[1:]:
        nats += _unpack_nats(p["nats"], len(nats))
    return docs.select(["doc_id", "lang"]).append_column("nats", pa.array(nats)).append_column("n", docs.column("n"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _filled(batches):
        h, n = np.unique(sequences(rows.column("text").to_pylist())[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])


def words_of(docs: DataFrame) -> DataFrame:
    """Hashes of all words and marks of texts, and how often they are there."""
    return materialize(docs.select("text").mapInArrow(_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))


def codes_for(trained: DataFrame, found: DataFrame, share: int, bucket_tokens: int) -> Codes | None:
    """Codes for the words of `trained`; None if there are over VOCABULARY. `found` are words_of one in `share` of all documents:
    the number of buckets and which words are heavy rest on it, and no result does."""
    known = words_of(trained).where(f"h not in ({BEGIN}, {END})")
    if known.count() > VOCABULARY:
        return None
    got = known.toArrow()
    words, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    numbers = np.empty(len(words), np.uint32)
    numbers[np.lexsort((words, -n))] = np.arange(3, len(words) + 3)
    order = np.argsort(words)
    tokens = (found.agg(F.sum("n")).first()[0] or 0) * share
    codes = Codes(words[order], numbers[order], np.zeros(0, np.uint32), np.zeros(0, np.uint64), max(1, -(-tokens // bucket_tokens)))
    heavy = found.where(F.col("n") * share > bucket_tokens / 2).select("h", "n").toArrow()
    number = codes.of(heavy.column("h").to_numpy().view(np.uint64))
    order = np.flatnonzero(number)[np.argsort(number[number > 0])]
    codes.heavy = number[order]
    codes.spread = np.minimum(codes.buckets, heavy.column("n").to_numpy()[order] * share * 2 // bucket_tokens + 1).astype(np.uint64)
    return codes


def score_by_exchange(docs: DataFrame, chosen: DataFrame, codes: Codes) -> DataFrame:
    """(doc_id, lang, nats, n) of all documents under the model of the `chosen`.

    A trigram goes to its middle word's bucket, which then holds its history, its bigram and that one's history, so a bucket
    needs but the continuation counts of last words. The n-gram table itself is never written; documents' trigrams are
    shuffled once, some bytes each, and come back as a sum for each document and bucket."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(codes)
    with scratch(docs.sparkSession) as keep:
        counts = _trained_on(docs, chosen).mapInArrow(_send(sent), PARTS).groupBy("bucket").applyInArrow(_counts(sent), COUNTS)
        counts = materialize(counts)
        heavy = keep(counts.where("kind = 0").groupBy("a").applyInArrow(_whole, COUNTS))
        counts = counts.where("kind != 0").unionByName(heavy.where("kind != 0"))
        none = F.lit(None).cast("binary")
        few = counts.where("kind != 1").groupBy("kind", "a").agg(F.sum("n").alias("n")).select("*", none.alias("words"), none.alias("ends"))
        ends = counts.where("kind = 1").groupBy("a").applyInArrow(_added, COUNTS)
        model = context.broadcast(Model.of(materialize(few.unionByName(ends)), len(codes.words)))
    own = F.broadcast(chosen.select("__id", F.lit(True).alias("__own")))
    rows = docs.select("doc_id", "lang", F.col("text").cast("binary").alias("text")).join(own, F.col("doc_id") == F.col("__id"), "left")
    rows = rows.select("doc_id", "lang", "text", F.coalesce("__own", F.lit(False)).alias("own"))
    parts = rows.mapInArrow(_send(sent, model), PARTS).unionByName(heavy.where("kind = 0").mapInArrow(_copies(sent), PARTS))
    parts = parts.groupBy("bucket").applyInArrow(_scores(model), "block long, bucket long, nats binary, meta binary")
    schema = T.StructType([docs.schema["doc_id"], docs.schema["lang"], T.StructField("nats", T.DoubleType()), T.StructField("n", T.LongType())])
    return parts.groupBy("block").applyInArrow(_sums, schema)


def _trained_on(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"), "left_semi").select("text")


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles goes when the query ends, so that one step's shuffle isn't on disk beside the next one's."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _score_by_table(docs: DataFrame, table: DataFrame, unknown: float, broadcast_rows: int) -> DataFrame:
    """(doc_id, lang, nats, n) of all documents by the n-gram table, broadcast or joined."""
    if table.count() <= broadcast_rows:
        shards = Shards.of(table, unknown)
        return docs.select("doc_id", "lang", _score_column(docs.sparkSession, F.col("text"), shards).alias("s")).select("doc_id", "lang", "s.nats", "s.n")
    rows = materialize(docs.select("doc_id", "lang", "text").withColumn("__row", F.monotonically_increasing_id()))
    return rows.join(score_by_join(rows, table, unknown), "__row").select("doc_id", "lang", "nats", "n")


def score(docs: DataFrame, labels: DataFrame, train_docs: int | None = None, quantile: float = QUANTILE, broadcast_rows: int = BROADCAST_ROWS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold (on the drawn mean surprisal), adjusted and kept."""
    with _cleaned(docs.sparkSession), scratch(docs.sparkSession) as keep:
        chosen = chosen_ids(labels, train_docs)
        with scratch(docs.sparkSession):
            share = max(1, docs.count() // SOME_DOCS)
            some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select(F.col("text").cast("binary").alias("text"))
            found = words_of(some)
            tokens = (found.agg(F.sum("n")).first()[0] or 0) / max(1, some.count())
            many = 2 * tokens * chosen.count() > broadcast_rows
            codes = codes_for(_trained_on(docs, chosen), found, share, bucket_tokens) if many else None
        scored = score_by_exchange(docs, chosen, codes) if codes else None
        if scored is None:
            scored = _score_by_table(docs, *train(docs, labels, train_docs, chosen)[:2], broadcast_rows)
        scored = materialize(scored)
        trusted = trusted_ids(labels).join(F.broadcast(chosen), "__id", "left_anti")
        fair = scored.join(materialize(trusted), F.col("doc_id") == F.col("__id"), "left_semi")
        means = materialize(scored.groupBy("lang").agg((F.sum("nats") / F.sum("n")).alias("__mean")).withColumnRenamed("lang", "__lang"))
        drawn = (F.col("nats") + PRIOR_WORDS * F.col("__mean")) / (F.col("n") + PRIOR_WORDS)
        same = F.col("lang").eqNullSafe(F.col("__lang"))
        limits = fair.join(F.broadcast(means), same).withColumn("drawn", drawn)
        limits = materialize(limits.select("__lang", "drawn", (F.col("drawn") - F.col("__mean")).alias("far")))
        spread = F.lit(limits.agg(F.percentile_approx("far", quantile, 10000)).first()[0]).cast("double")
        own = limits.groupBy("__lang").agg(F.count("far").alias("__n"), F.percentile_approx("far", quantile, 10000).alias("__far"))
        own = materialize(own.withColumnRenamed("__lang", "__of"))
        n = F.coalesce("__n", F.lit(0))
        far = (n * F.coalesce("__far", F.lit(0.0)) + SHRINK * spread) / (n + SHRINK)
        per = means.join(own, F.col("__lang").eqNullSafe(F.col("__of")), "left").select("__lang", "__mean", F.coalesce(F.col("__mean") + far, F.lit(float("inf"))).alias("threshold"))
        joined = scored.join(materialize(per), same).withColumn("adjusted", drawn)
        return keep(joined.select("doc_id", "lang", F.col("n").alias("n_tokens"), F.exp(F.col("nats") / F.col("n")).alias("perplexity"), "threshold", "adjusted", (F.col("adjusted") <= F.col("threshold")).alias("kept")))


def op3_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
