import re

import numpy as np
import pytest
import xxhash

from voxledger.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if b > a and (fps[a] ^ fps[b]).bit_count() <= 3:
                old, new = root[b], root[a]
                root = {k: min(old, new) if v in (old, new) else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("text", [None, "", "  \n", "one", "One two", "one two three", "É É é x A b c d e f g", "w " * 700, "a b c " * 300 + "tail"])
def test_fingerprint_matches_plain(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_chunked_text_has_the_same_fingerprint(monkeypatch):
    from voxledger.llm import common

    text = " ".join(f"word{i % 97}x{i % 13}" for i in range(4000)).encode()
    whole = simhash.fingerprint(text)
    for limit in (50, 64, 1000):
        monkeypatch.setattr(simhash, "words_in_chunks", lambda d, n=limit: common.words_in_chunks(d, n))
        assert simhash.fingerprint(text) == whole


def test_masks_cover_every_pair_within_tau():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, 500, np.uint64)
    for rows in (100, 10**6, 10**9, 10**11):
        masks = simhash.choose_masks(sample, rows)
        for _ in range(500):
            flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(m & flips == 0 for m in masks)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, extra int")


def test_components_on_a_fixture(spark):
    rng = np.random.default_rng(5)
    base = [f"w{int(x)}" for x in rng.integers(0, 5000, 400)]
    rows = [(None, "lost", "x", 1), (1, None, "x", 1), (2, "", None, 1), (3, "\t\n", "x", None)]
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 400, i % 4):
            words[at] = "changed"
        rows.append((10 + i, " ".join(words), "x", 1))
    rows += [(100 + i, " ".join(f"u{int(x)}" for x in rng.integers(0, 5000, 80)), "x", 1) for i in range(40)]
    rows += [(200, "same copy of a text", "x", 1)] * 3
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows if r[0] is not None}
    want = plain_components(fps)
    for bucket in (4096, 6):  # the second compares every bucket block by block
        got = simhash.near_duplicates(docs_of(spark, rows), bucket_rows=bucket).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is not None:
                assert r["fp"] % 2**64 == fps[r["doc_id"]]
                assert r["component_id"] == want[r["doc_id"]]


def test_forest_connects_what_links_connect_in_any_order():
    rng = np.random.default_rng(3)
    chain = [0]
    for i in range(40):  # neighbours differ in two bits, rows two apart in four
        chain.append(chain[-1] ^ (1 << i % 32) ^ (1 << 32 + (i * 7) % 32))
    for n in (7, 12, 41):
        for _ in range(200):
            fp = np.array(chain[:n], np.uint64)[rng.permutation(n)]
            group = np.sort(rng.integers(0, 2, n))
            got = np.arange(n)
            member, root = simhash.forest(group, fp)
            got[member] = root
            want = np.arange(n)
            for a in range(n):
                for b in range(a + 1, n):
                    if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= 3:
                        want[want == max(want[a], want[b])] = min(want[a], want[b])
            assert got.tolist() == want.tolist()


def test_long_chains_merge(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000), (2000, 2001)]
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert roots == {i: 0 for i in range(1, 201)} | {2001: 2000}


def test_keep_one_keeps_a_row_of_each_component(spark):
    rows = [(5, "a b c d", "x", 1), (4, "a b c d", "y", 2), (4, "a b c d", "y", 2), (9, "quite another text here", None, None), (None, None, None, None)]
    kept = simhash.keep_one(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "extra"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "9", "None"]


def test_keep_one_keeps_components_that_share_an_id(spark):
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"k{int(x)}" for x in rng.integers(0, 5000, 60))
    lost, again, copied = [text() for _ in range(6)], [text() for _ in range(5)], text()
    rows = [(None, t, "x", 1) for t in lost] * 2 + [(7, t, "x", 1) for t in again] * 2
    rows += [(None, copied, "x", 1), (3, copied, "x", 1), (3, copied, "x", 1), (8, copied, "x", 1), (4, None, "x", 1), (4, "", "x", 1)]
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in simhash.keep_one(docs_of(spark, rows)).collect())
    assert kept == sorted([("None", t) for t in lost] + [("7", t) for t in again] + [("3", copied), ("4", "")])


def test_empty_table(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).collect() == []
    assert simhash.keep_one(docs_of(spark, [])).collect() == []


def test_query_against_brute_force(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = plain_components(fps)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op6_simhash_near_dedup(spark, small).collect()}
    assert got == {(i, f"{fps[i]:016x}", want[i]) for i in docs}
