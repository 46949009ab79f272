import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from voxledger.llm import lm_scoring as m

SCHEMA = "doc_id long, text string, word string, lp string"


def plain_base(rows):
    split = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = Counter(w for d, t in rows if not held(d) for w in split(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        w = split(t)
        out.append((str(d), held(d), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return sorted(out)


def rows():
    out = [(i, " ".join(f"w{(i * k) % 23}" for k in range(i % 40))) for i in range(60)]
    return out + [(None, None), (None, "Lost words"), (100, ""), (101, "Ünïcode ÜNÏCODE 語 😀"), (7, "tie tie"), (7, "tie tie"), (102, "x" * 3000), (103, "often " * 700 + "seldom " * 255)]


def test_base_against_plain(spark):
    table = spark.createDataFrame([(d, t, "x", "y") for d, t in rows()], SCHEMA).repartition(3)
    for limit in (1 << 20, 40):
        got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in m.score_documents(table, block_words=limit, rounds=1).collect())
        want = plain_base(rows())
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5] for g in got], [w[5] for w in want])


def all_segmentations(model, word):
    text = m.START + word
    total, n = 0.0, len(text)
    for cuts in itertools.product((0, 1), repeat=n - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
        p = 1.0
        for a, b in zip(at, at[1:], strict=False):
            i = None if a and text[a] == m.START else model.index.get(text[a:b])
            if i is not None:
                p *= math.exp(model.logp[i])
            elif b - a == 1:
                p *= math.prod(math.exp(model.logp[len(model.pieces) + x]) for x in text[a].encode())
            else:
                p = 0.0
        total += p
    return math.log(total)


@pytest.mark.parametrize("word", ["a", "the", "within", "zzqé", "語x", "a▁b", "▁", "▁▁a"])
def test_forward_recursion_sums_all_segmentations(word):
    model = m.PieceModel.initial(m.vocabulary_path())
    assert model.log_probability(word.encode()) == pytest.approx(all_segmentations(model, word))


def test_the_start_mark_inside_a_word_is_not_a_word_border():
    model = m.PieceModel.initial(m.vocabulary_path())
    two = model.log_probability(b"a") + model.log_probability(b"b")
    assert model.log_probability("a▁b".encode()) < two - 1
    for word in ("a▁b", "▁▁a"):
        a, b = np.zeros(len(model.logp)), np.zeros(len(model.logp))
        model.expected_counts(word.encode(), 2.0, a)
        model._expected_counts_long(word.encode(), 2.0, b)
        assert np.allclose(a, b)


def test_a_frequent_word_costs_one_narrow_row_a_block(spark):
    """A word in every document: the rows that are joined on words hold no postings, and one row a block."""
    docs = spark.range(600).selectExpr("id AS doc_id", "false AS held", "CAST(concat('hot hot w', id) AS BINARY) AS text").repartition(3)
    rows = docs.mapInArrow(m._blocks(50), m.BLOCK_SCHEMA).collect()
    blocks = {r["block"] for r in rows}
    hot = [r for r in rows if r["word"] == b"hot"]
    assert len(blocks) > 20 and len(hot) == len(blocks)
    assert all(r["data"] == b"" for r in rows if r["number"] < m.LAST)
    assert sum(r["train"] for r in hot) == 1200


def test_clashing_names_and_a_long_text(spark):
    names = ["block", "number", "train", "data", "c", "score", "held"]
    table = spark.createDataFrame([(i, "a b " * (100_000 if i == 2 else 3), *names) for i in range(4)], ["doc_id", "text", *names])
    assert sorted((r.doc_id, r.n_tokens) for r in m.score_documents(table, rounds=1).collect()) == [(0, 7), (1, 7), (2, 200_001), (3, 7)]


def test_expected_counts_are_gradients():
    model = m.PieceModel.initial(m.vocabulary_path())
    counts = np.zeros(len(model.logp))
    model.expected_counts(b"there", 2.0, counts)
    for i in np.flatnonzero(counts)[:8]:
        up, down = model.logp.copy(), model.logp.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = (m.PieceModel(model.pieces, up).log_probability(b"there") - m.PieceModel(model.pieces, down).log_probability(b"there")) / 2e-4
        assert counts[i] == pytest.approx(2 * slope, rel=1e-3)


@pytest.mark.parametrize("letters", ["\U0001d400", "\ua000", "\U0001d400a"])
def test_words_without_pieces_do_not_underflow(letters):
    model = m.PieceModel.initial(m.vocabulary_path())
    for n in range(10, 24):
        word = (letters * n)[:n].encode()
        got, want = np.zeros(len(model.logp)), np.zeros(len(model.logp))
        model.expected_counts(word, 3, got)
        model._expected_counts_long(word, 3, want)
        assert np.isfinite(got).all() and np.allclose(got, want)
        assert math.isfinite(model.updated(got).log_probability(word))


def test_scores_are_sums_over_words_and_em_helps(spark):
    table = spark.createDataFrame([(d, t, "x", "y") for d, t in rows()], SCHEMA)
    words = Counter(w for d, t in rows() if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1 for w in (t or "").encode().lower().split())
    docs = sum(zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1 for d, _ in rows())
    counts = spark.createDataFrame([(bytearray(w), c) for w, c in words.items()], "word binary, c long")
    fits = [m.fit(counts, docs, m.vocabulary_path(), k) for k in (0, 1, 2)]
    total = [sum(c * f.log_probability(w) for w, c in words.items()) for f in fits]
    assert total[0] < total[1] < total[2]
    got = {(str(r.doc_id), r.n_tokens): r.score for r in m.score_documents(table, rounds=2).collect()}
    for d, t in rows():
        w = (t or "").encode().lower().split()
        want = (sum(fits[2].log_probability(x) for x in w) + fits[2].logp[-1]) / m.LOG10
        assert got[str(d), len(w) + 1] == pytest.approx(want, rel=1e-6)


def test_empty_table(spark):
    assert m.score_documents(spark.createDataFrame([], SCHEMA)).collect() == []
