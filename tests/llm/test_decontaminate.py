import hashlib
import random
import re

import numpy as np

from voxledger.llm import decontaminate as d

SCHEMA = "doc_id long, text string, spans string"


def plain(doc, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hit, found = split(doc), set(), set()
    for item, text in items:
        iw = split(text)
        n = min(window, len(iw))
        for k in range(len(iw) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == iw[k : k + n]:
                    hit.update(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def fixture():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["É", "x9"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 2, 5, 13, 14, 30])))) for i in range(12)] + [(3, "dup of three"), (None, "no id here"), (77, None), (78, "... !!")]
    docs = [(None, "no id here"), (1, None), (2, ""), (3, "?!"), (4, "No ID, here")]
    for i in range(60):
        parts = [rng.choice([items[rng.randrange(12)][1], " ".join(rng.choices(words, k=20)), "Dup-of THREE"]) for _ in range(rng.randrange(1, 6))]
        docs.append((10 + i % 50, " ".join(parts)))
    return docs, items


def results(spark, docs, items, **kw):
    table = spark.createDataFrame([(i, t, "s") for i, t in docs], SCHEMA)
    found = d.contamination(table, spark.createDataFrame(items, "item_id long, text string"), **kw)
    assert found.columns == ["row", "match"] and found.select("row.*").columns == table.columns
    rows = found.select("row.doc_id", "row.text", "match.*").collect()
    return sorted((str(r.doc_id), str(r.text), r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()) for r in rows)


def test_against_brute_force(spark):
    docs, items = fixture()
    want = sorted((str(i), str(t), *plain(t, items)) for i, t in docs)
    assert results(spark, docs, items) == want
    assert results(spark, docs, items, block_words=40) == want  # several blocks of items
    assert results(spark, docs, items, block_words=26) == want  # items longer than a block


def test_no_block_is_over_its_bound(spark):
    items = [(1, " ".join(f"w{i}" for i in range(1000))), (2, "a b c"), (3, " ".join(f"v{i}" for i in range(100)))]
    blocks = list(d._blocks(spark.createDataFrame(items, "item_id long, text string"), 100))
    assert all(len(b.vocabulary) <= 100 for b in blocks)
    windows = {tuple(sorted(b.vocabulary, key=b.vocabulary.get)[i - 1] for i in w) for b in blocks for ws, _ in b.windows for w in ws.tolist()}
    want = {tuple(w[i : i + 13]) for _, t in items for w in [t.encode().split()] for i in range(max(1, len(w) - 12))}
    assert windows == want


def test_clashing_names(spark):
    names = ["row", "match", "m", "d", "h", "s", "i", "__match"]
    docs, items = fixture()
    table = spark.createDataFrame([(i, t, *names) for i, t in docs], ", ".join(["doc_id long, text string"] + [f"{n} string" for n in names]))
    for words in (1 << 20, 40):
        kept = d.contamination(table, spark.createDataFrame(items, "item_id long, text string"), words).where(~d.contaminated()).select("row.*")
        assert kept.columns == table.columns and {tuple(r)[2:] for r in kept.collect()} == {tuple(names)}


def test_small_shards_and_long_texts(monkeypatch):
    docs, items = fixture()
    block = d.Block.of([(None if i is None else str(i), d.item_words((t or "").encode())) for i, t in items if d.item_words((t or "").encode())])
    texts = [None if t is None else t.encode() for _, t in docs]
    whole = d.find_matches(texts, block)
    assert d.find_matches(texts, block, shard_words=30) == whole
    from voxledger.llm import common

    monkeypatch.setattr(d, "words_in_chunks", lambda x: common.words_in_chunks(x, 40))
    assert d.find_matches(texts, block) == whole


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    tokens = rng.integers(0, 3, 500)
    order = d.suffix_array(tokens, 13)
    padded = np.r_[tokens, [-1] * 13]
    keys = [tuple(padded[i : i + 13]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(500))


def test_empty_tables(spark):
    docs, items = fixture()
    assert results(spark, [], items) == []
    assert all(r[3] == 0 and r[4] == 0 for r in results(spark, docs, []))


def test_filter_keeps_columns(spark):
    docs, items = fixture()
    table = spark.createDataFrame([(i, t, "s") for i, t in docs], SCHEMA)
    kept = d.drop_contaminated(table, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == table.columns
    clean = sorted(str(t) for _, t in docs if not ((p := plain(t, items))[1] > 0 and 20 * p[1] >= p[0]))
    assert sorted(str(r.text) for r in kept.collect()) == clean
