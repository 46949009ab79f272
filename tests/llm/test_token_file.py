import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxledger.llm import token_file as t

TEXTS = [
    None, "", " \n", "Hello, world!", "the cat's can't DON'T I'll", "ÉCOLE école école Straße ΣΑΣ σας İstanbul", "a<|endoftext|>b <|ENDOFTEXT|> x", "123 4.5 ½ ² x²", "日本語 テキスト",
    "soft­hyphen nb space  em \x1c \x85 zero​width", "😀 emoji 👩‍👩‍👧", "ﬁ ligature ª º µ ß ÿ ÷ ×", "ends. with; punct: marks!? ", "a" * 300, "x\x00y", "word " * 5000, "École, ÉTÉ! naïve?! ñandú... d'été, l'ÉTÉ. Ÿ ÿ, Þór;: a,b .c ,, é́ e\u0301, A\u030a.", "x<|startoftext|>, y<|endoftext|>.", "thnd*** err$$$ ou.### a%%% b'. c-d- (e) [f]_ 9*** école&&& é'é",
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(t.tokenizer_path())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, t.END_ID]


@pytest.mark.parametrize("text", TEXTS)
def test_word_by_word_encoding_equals_whole_text_encoding(plain, text):
    data = None if text is None else text.encode()
    assert np.frombuffer(t.encode(data, t.word_ids(t.tokenizer_path())), "<u4").tolist() == plain(text)


def test_coding_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype("<u4")
        assert np.array_equal(t.unpack(*t.pack(v), n), v)


def test_files_round_trip(spark, plain):
    rows = [(i * 7 % 31 - 3, x, 1, "e") for i, x in enumerate(TEXTS)] + [(None, "no id", 2, "e"), (4, "tie b", 1, "e"), (4, "tie a", 1, "e"), (4, "tie a", 1, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, path string").repartition(3)
    got = t.token_table(docs).collect()
    assert len(got) == len(rows)
    want = sorted(("" if d is None else f"{d + 100:05d}", len(plain(x)), zlib.crc32(np.array(plain(x), "<u4").tobytes())) for d, x, _, _ in rows)
    assert sorted(("" if r.doc_id is None else f"{r.doc_id + 100:05d}", r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))


def test_empty_table(spark):
    assert t.token_table(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_whole_text_encoding(spark, small, plain):
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    at, want = 0, []
    for d in sorted(docs):
        want.append((d, at, len(docs[d]), zlib.crc32(np.array(docs[d], "<u4").tobytes())))
        at += len(docs[d])
    assert sorted(map(tuple, t.op8_token_ids(spark, small).collect())) == want


def test_many_equal_rows_clashing_names_and_a_very_long_text(spark, plain):
    """A third of all rows are equal, and are dealt over several files; one text is longer than what is cut or held at once."""
    long = "lower Case, words " * 300_000
    assert len(long) > max(t.PART_BYTES, 4 << 20)
    rows = [(9, "same text", 1, "x", 2)] * 900 + [(i, f"text {i}", 1, "x", 2) for i in range(1000, 2800)] + [(5, long, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int, ids string, n int").repartition(8)
    got = t.token_table(docs).collect()
    known: dict = {}
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((d, *known.setdefault(x, (len(plain(x)), zlib.crc32(np.array(plain(x), "<u4").tobytes())))) for d, x, *_ in rows)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    table = t.encoded(docs, t.tokenizer_path()).withColumn("n", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("n").asc()]
    dealt = table.where("doc_id = 9").repartitionByRange(4, *order).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in dealt) < 600
