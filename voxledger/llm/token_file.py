"""Operator 8: token ids in a binary file format.

Ids are ranked by how often the corpus has them (equal counts by id), so frequent ids are small numbers,
and written in byte-aligned variable-length coding: a stream of control bytes, each with the byte lengths
of four numbers (two bits each), apart from the stream of their data bytes. Reading back is a numpy table
lookup: a control byte selects the mask of data bytes in four 4-byte words.

Texts are encoded once, where they are; from then on ids move, two bytes each while the vocabulary allows, and
texts never do. The encoded table is removed when the files are written.

Files: documents in ascending doc_id order (nulls first, repeated ids by text hash), one file for each
range of doc_ids, each a series of blocks of about BLOCK_IDS ids. Tasks write to the shared folder under
names of their own attempt; the manifest table of the attempts that Spark committed says which files count,
so a lost executor or a second attempt can't mix into the result. The 4-byte rank table is bounded by the
vocabulary, and is all that is collected.

Encoding: the tokenizer drops white space and never joins words across it, so a text's ids are those of
its ASCII-white-space words in turn. Words are encoded with the tokenizers library and kept, up to
CACHE_WORDS a worker. Words of ASCII and Latin-1 letters alone are single pre-tokens and go straight to
the library's BPE model; such a word with closing punctuation is two pre-tokens, letters and marks; all
others take the full pipeline.

Null and empty texts have only the end id. Very long texts are encoded some megabytes at a time. Repeated rows
are written one by one; equal (doc_id, text) rows are interchangeable. An empty table gives no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, read_table, scratch, shared_dir, stored, words_in_chunks

END_ID = 2
BLOCK_IDS = 1 << 20
CACHE_WORDS = 400_000
PART_BYTES = 4 << 20
MAGIC = b"VOXTOK1\n"
HEAD = "<QQQQ"  # documents, ids, control bytes, data bytes

#: Letters that NFC leaves alone and whose lower case is one letter of the same kind: ASCII and Latin-1.
_PLAIN = frozenset(chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]) - {"×", "÷"}
#: Marks that, after a letter and up to the word's end, are a pre-token of their own: ASCII punctuation but
#: the apostrophe, which can open a pre-token with letters, and the marks in special tokens.
_CLOSING = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<|>")
#: The byte-level alphabet of byte-level BPE: printable Latin-1 bytes stand for themselves, the others
#: follow from U+0100 in order.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(b) for b in _SELF} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _SELF)}


class WordIds(dict):
    """Words to their ids, as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans(_BYTE_CHARS)
        self.seen: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        letters = word.rstrip(_CLOSING)
        if letters.isalpha():  # bytes: A-Z and a-z alone
            if len(letters) < len(word):
                out = self[letters] + self.marks(word[len(letters) :])
            else:
                out = array("I", [t.id for t in self.model.tokenize(word.lower().decode())]).tobytes()
        elif letters and _PLAIN.issuperset(text := letters.decode("utf-8", "replace")):
            if len(letters) < len(word):
                out = self[letters] + self.marks(word[len(letters) :])
            else:
                spelt = text.lower().encode().decode("latin-1").translate(self.letters)
                out = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        else:
            out = self.marks(word)
        if len(self) < CACHE_WORDS:
            self[word] = out
        return out

    def marks(self, word: bytes) -> bytes:
        """The full pipeline, for anything."""
        if (known := self.seen.get(word)) is None:
            known = array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
            if len(self.seen) < 10_000:
                self.seen[word] = known
        return known


@cache
def word_ids(path: str) -> WordIds:
    """One table for each worker process, kept between tasks."""
    return WordIds(path)


def encode(data: bytes | None, table: WordIds) -> bytes:
    """The text's ids and the end id. A-Z are lowered first, as the tokenizer does, unless the text may
    hold a special token's string."""
    text = data or b""
    parts = words_in_chunks(text if b"<|" in text else text.lower())
    return b"".join([b"".join(map(table.__getitem__, words)) for words in parts]) + struct.pack("<I", END_ID)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


# ---------------------------------------------------------------- the coding

#: For each control byte, which bytes of four 4-byte words are in the data stream.
_MASKS = np.array([[[b < (c >> 2 * k & 3) + 1 for b in range(4)] for k in range(4)] for c in range(256)])


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 numbers; the last four are filled up with zeros."""
    v = np.zeros(-(-len(numbers) // 4) * 4, "<u4")
    v[: len(numbers)] = numbers
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    q = code.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    return control.tobytes(), v.view(np.uint8)[_MASKS[control].reshape(-1)].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    mask = _MASKS[np.frombuffer(control, np.uint8)].reshape(-1)
    out = np.zeros(len(mask), np.uint8)
    out[mask] = np.frombuffer(data, np.uint8)
    return out.view("<u4")[:n]


def read_file(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a file: doc_ids, which of them are null, ids of each document, and all their ranks."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name, buffer_size=4 << 20) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token file")
        while head := f.read(struct.calcsize(HEAD)):
            docs, ids, n_control, n_data = struct.unpack(HEAD, head)
            doc_ids, null = np.frombuffer(f.read(8 * docs), "<i8"), np.frombuffer(f.read(docs), np.uint8).astype(bool)
            lengths = np.frombuffer(f.read(8 * docs), "<i8")
            yield doc_ids, null, lengths, unpack(f.read(n_control), f.read(n_data), ids)


# ---------------------------------------------------------------- the jobs


def _kind(size: int) -> str:
    """How an id is stored while it travels."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _encode(path: str, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kind = word_ids(path), _kind(size)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held, n, begin = [], 0, at
                while at < batch.num_rows and n < PART_BYTES:  # bounds what is held besides the batch
                    ids = np.frombuffer(encode(batch.column(2)[at].as_py(), table), "<u4").astype(kind)
                    held.append(ids.tobytes())
                    n, at = n + len(held[-1]), at + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at - begin), batch.column(1).slice(begin, at - begin), pa.array(held, pa.binary())], names=["doc_id", "h", "ids"])

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, a hash of the text and the ids (with the end id) of every row of docs, as bytes."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_encode(path, vocabulary_size(path)), "doc_id long, h long, ids binary")


def _count(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # bounds what is joined at once
                total += np.bincount(np.frombuffer(b"".join(batch.column(0).slice(at, 1000).to_pylist()), _kind(size)), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    return run


def id_ranks(table: DataFrame, size: int) -> np.ndarray:
    """The id of each rank, most frequent first; at most one entry for each id of the vocabulary."""
    counts = table.select("ids").mapInArrow(_count(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))], np.int64)


def _write(folder: str, kind: str, id_of: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rank_of = np.zeros(int(id_of.max(initial=0)) + 1, "<u4")
        rank_of[id_of] = np.arange(len(id_of))
        part = task.partitionId()
        name = f"{folder}/part-{part:06d}-{task.taskAttemptId()}.tok"
        store, at = fs.FileSystem.from_uri(name)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        docs = total = 0
        with store.open_output_stream(at) as f:
            f.write(MAGIC)
            held: list[tuple[int | None, np.ndarray]] = []
            size = 0

            def block() -> None:
                ranks = rank_of[np.concatenate([x for _, x in held])]
                control, data = pack(ranks)
                f.write(struct.pack(HEAD, len(held), len(ranks), len(control), len(data)))
                f.write(np.array([d or 0 for d, _ in held], "<i8").tobytes())
                f.write(np.array([d is None for d, _ in held], np.uint8).tobytes())
                f.write(np.array([len(x) for _, x in held], "<i8").tobytes())
                f.write(control)
                f.write(data)

            for batch in batches:
                for doc, ids in zip(batch.column(0), batch.column(1), strict=True):
                    held.append((doc.as_py(), np.frombuffer(ids.as_buffer(), kind)))
                    size += len(held[-1][1])
                    docs, total = docs + 1, total + len(held[-1][1])
                    if size >= BLOCK_IDS:
                        block()
                        held, size = [], 0
            if held:
                block()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "docs": pa.array([docs], pa.int64()), "ids": pa.array([total], pa.int64())})

    return run


def write_tokens(table: DataFrame, size: int, id_of: np.ndarray, folder: str) -> DataFrame:
    """Write encoded documents (with a row number `n`) to token files in `folder`; the manifest (part, path, docs, ids)
    in file order. The row number comes last in the order, so that equal rows can be parted."""
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("n").asc()]
    ordered = table.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return ordered.mapInArrow(_write(folder, _kind(size), id_of), "part int, path string, docs long, ids long")


def _read(id_of: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = id_of.astype("<u4")
        for batch in batches:
            for row in batch.to_pylist():
                at = row["before"]
                for doc_ids, null, lengths, ranks in read_file(row["path"]):
                    raw, ends = memoryview(ids_of[ranks].tobytes()), np.cumsum(lengths)
                    starts = ends - lengths
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, mask=null), pa.array(at + starts), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )
                    at += int(ends[-1])

    return run


def read_tokens(manifest: DataFrame, id_of: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    files = manifest.where("docs > 0").select("path", before)
    return files.repartition(n).mapInArrow(_read(id_of), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, write and read back: one row for each row of docs."""
    path, spark = path or tokenizer_path(), docs.sparkSession
    size, folder = vocabulary_size(path), shared_dir(spark)
    with scratch(spark):
        table = materialize(encoded(docs, path).withColumn("n", F.monotonically_increasing_id()))
        id_of = id_ranks(table, size)
        manifest = stored(write_tokens(table, size, id_of, f"{folder}/tokens"), f"{folder}/manifest")
    return read_tokens(manifest, id_of)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(read_table(spark, sf_dir, "documents"))
