"""Operator 10: language-model scores from a subword lattice.

Tokens: words of the text with A-Z lowered, then one end. Documents whose crc32(doc_id as text) mod 5 is
not 1 are learned from; all are scored.

The model: the pieces of an existing subword vocabulary, each with a unigram probability. A text's
probability is the sum over all its segmentations of the product of their pieces, times that of the end.
Pieces never cross a word's start mark, so the sum is a product over words, and each distinct word needs
one log-space forward recursion over its lattice. Probabilities start from the vocabulary's own order of
pieces (a piece's chance falls with its place) and take EM_ROUNDS of expectation-maximisation over the
distinct training words, weighted by their counts. Characters without a piece are spelt in byte pieces.

Jobs: every task turns its documents into blocks and writes a row for each distinct word of a block and one row
that holds which documents have which word and how often. Word counts are sums over the word rows; a word's count
and log probability are joined to its word rows, one narrow row for each block that has it, and go back to the
block's task, where they meet the block's own row and are added up by document. What is attached to a word never
travels with the join, so a frequent word costs one narrow row a block; adaptive execution splits it beyond that.
What is gathered grows with the corpus: all distinct words and their counts. Only the piece table, as long as the
vocabulary, is collected.

Null and empty texts are the end alone. A null doc_id counts as the text ''. Repeated rows are learned
from and scored one by one. Without training documents counts are zero and pieces keep their first
probabilities. A word of any length is one lattice, linear in its length; the start mark itself, inside a word,
is spelt in bytes, so no two words share a spelling. An empty table gives no rows. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, scratch, words_in_chunks

FOLDS, HELD_OUT = 5, 1
BLOCK_WORDS = 3 << 20
BLOCK_DOCS = 60_000
EM_ROUNDS = 2
START = "▁"
SHORT = 24
#: Least probability of a word in plain probabilities.
SAFE = 1e-250
LOG10 = math.log(10)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class PieceModel:
    """Natural-log probabilities of pieces, of the 256 byte pieces and of the end."""

    pieces: list[str]
    logp: np.ndarray  # pieces, then bytes, then the end

    def __post_init__(self) -> None:
        self.index = {p: i for i, p in enumerate(self.pieces)}
        #: Every beginning of a piece: its number if it is one itself, else -1.
        self.begins = dict.fromkeys((p[:k] for p in self.pieces for k in range(1, len(p))), -1) | self.index

    @classmethod
    def initial(cls, path: str) -> PieceModel:
        """Pieces that hold no start mark but as their first character, with chances by their place."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ranked = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        pieces = [p for p in map(sp.id_to_piece, ranked) if p and START not in p[1:]]
        chance = np.r_[1 / (np.arange(len(pieces)) + 10.0), np.full(256, 1e-5), 0.01]
        return cls(pieces, np.log(chance / chance.sum()))

    def edges(self, word: bytes) -> Iterator[tuple[int, int, float, tuple[int, ...]]]:
        """The lattice of a word, in order of starts: start, end, log probability, pieces."""
        text = START + word.decode("utf-8", "replace")
        get, logp, known = self.begins.get, self.logp, len(self.pieces)
        for start in range(len(text)):
            if text[start] not in self.index or (start and text[start] == START):
                ids = tuple(known + b for b in text[start].encode())
                yield start, start + 1, sum(logp[i] for i in ids), ids
                if text[start] == START:
                    continue
            for end in range(start + 1, len(text) + 1):
                if (i := get(text[start:end])) is None:
                    break
                if i >= 0:
                    yield start, end, logp[i], (i,)

    def log_probability(self, word: bytes) -> float:
        """Natural log of the word's probability over all segmentations: the forward recursion."""
        text = START + word.decode("utf-8", "replace")
        get, scores, index, exp, log = self.begins.get, self.scores(), self.index, math.exp, math.log
        known, n = len(self.pieces), len(text)
        terms: list[list[float]] = [[0.0], *([] for _ in range(n))]
        for start in range(n + 1):
            own = terms[start]
            if len(own) == 1:
                alpha = own[0]
            else:
                top = max(own)
                alpha = top + log(sum([exp(t - top) for t in own]))
            if start == n:
                break
            if text[start] not in index or (start and text[start] == START):
                terms[start + 1].append(alpha + sum([scores[known + b] for b in text[start].encode()]))
                if text[start] == START:
                    continue
            for end in range(start + 1, n + 1):
                if (i := get(text[start:end])) is None:
                    break
                if i >= 0:
                    terms[end].append(alpha + scores[i])
        return alpha

    def scores(self) -> list[float]:
        """logp as plain floats, faster one by one than an array's items."""
        if getattr(self, "_scores", None) is None:
            self._scores = self.logp.tolist()
        return self._scores

    def expected_counts(self, word: bytes, weight: float, into: list[float] | np.ndarray) -> None:
        """Add the expected uses of each piece in `weight` occurrences of the word: forward-backward. Words of
        up to SHORT characters take plain probabilities, longer ones logarithms, and so do those whose
        probability is so small (many characters spelt in bytes) that parts of it may underflow."""
        text = START + word.decode("utf-8", "replace")
        if len(text) > SHORT:
            return self._expected_counts_long(word, weight, into)
        get, p, index, known = self.begins.get, self.chances(), self.index, len(self.pieces)
        n = len(text)
        edges = []
        forward, backward = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for start in range(n):
            here = forward[start]
            if text[start] not in index or (start and text[start] == START):
                ids = [known + b for b in text[start].encode()]
                q = math.prod([p[i] for i in ids])
                edges.append((start, start + 1, ids, q))
                forward[start + 1] += here * q
                if text[start] == START:
                    continue
            for end in range(start + 1, n + 1):
                if (i := get(text[start:end])) is None:
                    break
                if i >= 0:
                    edges.append((start, end, i, p[i]))
                    forward[end] += here * p[i]
        if forward[n] < SAFE:
            return self._expected_counts_long(word, weight, into)
        scale = weight / forward[n]
        for start, end, i, q in reversed(edges):
            use = q * backward[end]
            backward[start] += use
            share = forward[start] * use * scale
            if type(i) is int:
                into[i] += share
            else:
                for k in i:
                    into[k] += share

    def chances(self) -> list[float]:
        if getattr(self, "_chances", None) is None:
            self._chances = np.exp(self.logp).tolist()
        return self._chances

    def _expected_counts_long(self, word: bytes, weight: float, into: list[float] | np.ndarray) -> None:
        edges = list(self.edges(word))
        n = edges[-1][1]
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        for s, e, lp, _ in edges:
            alpha[e] = np.logaddexp(alpha[e], alpha[s] + lp)
        for s, e, lp, _ in reversed(edges):
            beta[s] = np.logaddexp(beta[s], lp + beta[e])
        for s, e, lp, ids in edges:
            share = weight * math.exp(min(0.0, alpha[s] + lp + beta[e] - alpha[n]))
            for i in ids:
                into[i] += share

    def updated(self, counts: np.ndarray) -> PieceModel:
        smoothed = counts + 0.5
        return PieceModel(self.pieces, np.log(smoothed / smoothed.sum()))


# ---------------------------------------------------------------- blocks of documents by word

#: Rows of a block: its words, numbered, with their counts in training documents, and last the block's own row.
BLOCK_SCHEMA = "block long, number int, word binary, train long, data binary"
_ARROW = pa.schema([("block", pa.int64()), ("number", pa.int32()), ("word", pa.binary()), ("train", pa.int64()), ("data", pa.binary())])
#: The number of a block's own row, after all words.
LAST = 2**31 - 1


@dataclass
class Postings:
    """A block's own row: of each word in turn, the places of the documents that have it and how often; and
    of each document its id, whether that is null, whether it is held out, and its length in words. Counts
    take a byte each; those of 255 and more stand apart, in order."""

    starts: np.ndarray
    docs: np.ndarray
    few: np.ndarray
    many: np.ndarray
    ids: np.ndarray
    null: np.ndarray
    held: np.ndarray
    lengths: np.ndarray

    KINDS = ("<i8", "<u2", "u1", "<u4", "<i8", "?", "?", "<i8")

    @property
    def counts(self) -> np.ndarray:
        out = self.few.astype(np.int64)
        out[self.few == 255] = self.many
        return out

    def to_bytes(self) -> bytes:
        parts = [np.asarray(x, k) for x, k in zip(vars(self).values(), self.KINDS, strict=True)]
        return np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Postings:
        sizes, at, parts = np.frombuffer(data, "<i8", len(cls.KINDS)), 8 * len(cls.KINDS), []
        for n, kind in zip(sizes.tolist(), cls.KINDS, strict=True):
            parts.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return cls(*parts)


def _blocks(limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        vocabulary: dict[bytes, int] = {}
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        held: list[bool] = []
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            n, v, block = len(doc_ids), len(vocabulary), (made << 32) + part
            lengths = np.array([len(x) for x in ids])
            key = np.concatenate(ids).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
            key, counts = np.unique(key, return_counts=True)
            word, doc = key // n, key % n
            train = np.bincount(word, counts * ~np.array(held)[doc], v).astype(np.int64)
            starts = np.searchsorted(word, np.arange(v + 1))
            if v:
                words = pa.array(list(vocabulary), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(v, block)), pa.array(np.arange(v, dtype=np.int32)), words, pa.array(train), pa.array([b""] * v, pa.binary())], schema=_ARROW)
            own = Postings(starts, doc, np.minimum(counts, 255), counts[counts >= 255], [d or 0 for d in doc_ids], [d is None for d in doc_ids], held, lengths)
            row = {"block": block, "number": LAST, "word": b"", "train": n - sum(held), "data": own.to_bytes()}
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for doc_id, is_held, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                parts = []
                for words in words_in_chunks((text.as_py() or b"").lower()):
                    parts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
                ids.append(np.concatenate(parts))
                doc_ids.append(doc_id.as_py())
                held.append(is_held.as_py())
                size += len(ids[-1])
                if size >= limit or len(doc_ids) >= BLOCK_DOCS:
                    yield from emit()
                    vocabulary, ids, doc_ids, held, size, made = {}, [], [], [], 0, made + 1
        if doc_ids:
            yield from emit()

    return run


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def fit(words: DataFrame, train_docs: int, path: str, rounds: int = EM_ROUNDS) -> PieceModel:
    """Piece probabilities from training words (word, c); sums by piece are all that is collected."""
    model = PieceModel.initial(path)
    if not train_docs:
        return model
    for _ in range(rounds):
        now = model

        def expect(batches: Iterator[pa.RecordBatch], now: PieceModel = now) -> Iterator[pa.RecordBatch]:
            sums = [0.0] * len(now.logp)
            for batch in batches:
                for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    now.expected_counts(word, c, sums)
            total = np.array(sums)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "n"])

        sums = words.where("c > 0").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(model.logp))
        for r in sums:
            counts[r["piece"]] = r["n"]
        counts[-1] = train_docs
        model = model.updated(counts)
    return model


def _word_scores(model: PieceModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lp = [model.log_probability(w) / LOG10 for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp, pa.float64())], names=["word", "c", "lp"])

    return run


def _gather(total: int, distinct: int, train_docs: int, end_lp: float) -> Callable:
    """Adds up the words of blocks by document; rows come block by block, a block's own row after its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = math.log10(total + 0.5 * (distinct + 1))
        end = math.log10(train_docs + 0.5) - below
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            number, c, lp = (batch.column(k).to_numpy() for k in (1, 2, 3))
            at = 0
            for last in np.flatnonzero(number == LAST).tolist():
                held.append((c[at:last], lp[at:last]))
                at = last + 1
                own, known, scores = Postings.from_bytes(batch.column(4)[last].as_py()), *map(np.concatenate, zip(*held, strict=True))
                held, m, each = [], len(own.lengths), np.diff(own.starts)
                if len(known) != len(each):
                    raise ValueError(f"a block of {len(each)} words got {len(known)}")
                add = lambda x, own=own, counts=own.counts, each=each, m=m: np.bincount(own.docs, counts * np.repeat(x, each), m)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.ids, pa.int64(), mask=own.null), pa.array(own.held), pa.array(own.lengths + 1), pa.array(add(known > 0).astype(np.int64) + (train_docs > 0)),
                        pa.array(np.full(m, total)), pa.array(add(np.log10(known + 0.5) - below) + end), pa.array(add(scores) + end_lp),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            held.append((c[at:], lp[at:]))

    return run


def score_documents(docs: DataFrame, path: str | None = None, block_words: int = BLOCK_WORDS, rounds: int = EM_ROUNDS) -> DataFrame:
    """One row for each row of docs: fold, token counts, base score and lattice score."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", held_out().alias("held"), F.col("text").cast("binary").alias("text"))
    with scratch(docs.sparkSession) as keep:
        blocks = materialize(rows.mapInArrow(_blocks(block_words), BLOCK_SCHEMA))
        own, last = blocks.where(F.col("number") < LAST).select("block", "number", "word", "train"), blocks.where(F.col("number") == LAST)
        words = materialize(own.groupBy("word").agg(F.sum("train").alias("c")))
        train_docs = last.agg(F.sum("train")).first()[0] or 0
        n_words, seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
        model = fit(words, train_docs, path or vocabulary_path(), rounds)
        scored = materialize(words.mapInArrow(_word_scores(model), "word binary, c long, lp double"))
        found = own.select("block", "number", "word").join(scored, "word").select("block", "number", "c", "lp", F.lit(b"").alias("data"))
        found = found.unionByName(last.select("block", "number", F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("lp"), "data"))
        # Blocks count up within tasks: the low half of a block's number is its task.
        place = F.pmod(F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)) + F.shiftright("block", 32) * 31, F.lit(n)).cast("int")
        dealt = found.repartitionById(n, place).sortWithinPartitions("block", "number")
        gather = _gather(n_words + train_docs, seen + (train_docs > 0), train_docs, float(model.logp[-1]) / LOG10)
        return keep(dealt.mapInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
