import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxledger.llm import ngram_quality as k

DOCS = "doc_id long, text string, lang string, n long, nats string"


def plain_model(texts):
    """Interpolated modified Kneser-Ney by its definition; returns p(w | u, v)."""
    c3 = Counter()
    for t in texts:
        s = ["<s>", "<s>", *(t or "").encode().lower().split(), "</s>"]
        c3.update(zip(s, s[1:], s[2:], strict=False))
    c2 = defaultdict(int)
    for (_, v, w), n in c3.items():
        c2[v, w] += n if v == "<s>" else 1
    c1 = Counter(w for _, w in c2)

    def order(counts):
        d = k.discounts(Counter(c for c in counts.values() if c <= 4))
        cut = lambda c: d[min(c, 3) - 1]
        total, freed = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            freed[g[:-1]] += cut(c)
        a = {g: (c - cut(c)) / total[g[:-1]] for g, c in counts.items()}
        return a, {h: freed[h] / total[h] for h in total}

    a3, g3 = order(c3)
    a2, g2 = order(c2)
    a1, g1 = order({(w,): c for w, c in c1.items()})
    unknown = g1[()] / (len(c1) + 1)

    def p(u, v, w):
        return a3.get((u, v, w), 0) + g3.get((u, v), 1) * (a2.get((v, w), 0) + g2.get((v,), 1) * (a1.get((w,), 0) + unknown))

    return p, {w for (w,) in a1}


def tables(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words, n, p=np.arange(30, 0, -1) / 465))
    docs = [(i, text(int(rng.integers(1, 60))), "en" if i % 3 else None, 1, "x") for i in range(90)]
    docs += [(200, None, "en", 1, "x"), (201, "", "fr", 1, "x"), (None, "w1 w2", "en", 1, "x"), (5, docs[5][1], docs[5][2], 1, "x"), (202, "zzz qqq " * 40, "en", 1, "x")]
    labels = [(i, 1, 0) for i in range(60)] + [(3, 0, 0), (4, None, 0), (None, 1, 0), (999, 1, 0)]
    return docs, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_probabilities_sum_to_one_and_match_the_definition(spark):
    docs, table, labels = tables(spark)
    grams, unknown, chosen = k.train(table, labels, 1000)
    shards = k.Shards.of(grams, unknown)
    ids = {r[0] for r in chosen.collect()}
    assert 3 not in ids and 59 in ids
    trained = [t for d, t, *_ in docs if d in ids]
    p, known = plain_model(trained)
    vocabulary = [*known, "<unk>"]
    assert sum(p(b"w1", b"w2", w) for w in vocabulary) == pytest.approx(1)
    assert sum(p("<s>", "<s>", w) for w in vocabulary) == pytest.approx(1)
    nats, n = shards.surprisal([None if t is None else t.encode() for _, t, *_ in docs])
    for i, (_, t, *_) in enumerate(docs):
        s = ["<s>", "<s>", *(t or "").encode().lower().split(), "</s>"]
        want = -sum(math.log(p(*g)) for g in zip(s, s[1:], s[2:], strict=False))
        assert n[i] == len(s) - 2 and nats[i] == pytest.approx(want)


def test_shuffle_join_gives_the_same_scores(spark):
    _, table, labels = tables(spark)
    both = [sorted((str(r.doc_id), r.n_tokens, round(r.perplexity, 6), r.kept) for r in k.score(table, labels, broadcast_rows=b).collect()) for b in (10**9, 0)]
    assert both[0] == both[1] and len(both[0]) == table.count()


def test_bound_and_empty_tables(spark):
    _, table, labels = tables(spark)
    assert k.train(table, labels, 7)[2].count() == 7
    assert k.score(table.limit(0), labels).collect() == []
    assert all(r.kept for r in k.score(table, labels.limit(0)).collect())


def test_verdicts_against_plain(spark):
    """Means by language, held-out quantiles and `kept`, from the probabilities of the plain model."""
    docs, table, labels = tables(spark)
    docs = docs + [(1000 + i, docs[i % 90][1], "en", 1, "x") for i in range(700)]
    table = spark.createDataFrame(docs, DOCS)
    labels = labels.unionByName(spark.createDataFrame([(1000 + i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int"))
    ids = {r[0] for r in k.train(table, labels)[2].collect()}
    trusted = {r[0] for r in k.trusted_ids(labels).collect()}
    p, _ = plain_model([t for d, t, *_ in docs if d in ids])
    scored = []
    for d, t, lang, *_ in docs:
        s = ["<s>", "<s>", *(t or "").encode().lower().split(), "</s>"]
        scored.append((d, lang, -sum(math.log(p(*g)) for g in zip(s, s[1:], s[2:], strict=False)), len(s) - 2))
    mean = {lang: sum(x[2] for x in scored if x[1] == lang) / sum(x[3] for x in scored if x[1] == lang) for lang in {x[1] for x in scored}}
    drawn = lambda x: (x[2] + k.PRIOR_WORDS * mean[x[1]]) / (x[3] + k.PRIOR_WORDS)
    fair = [x for x in scored if x[0] in trusted - ids]
    at = lambda v: sorted(v)[max(0, math.ceil(k.QUANTILE * len(v)) - 1)]
    far = at([drawn(x) - mean[x[1]] for x in fair])
    n = {lang: sum(x[1] == lang for x in fair) for lang in mean}
    own = {lang: at([drawn(x) - mean[lang] for x in fair if x[1] == lang]) if n[lang] else 0 for lang in mean}
    limit = {lang: mean[lang] + (n[lang] * own[lang] + k.SHRINK * far) / (n[lang] + k.SHRINK) for lang in mean}
    want = sorted((str(x[0]), str(x[1]), x[3], round(math.exp(x[2] / x[3]), 6), drawn(x) <= limit[x[1]] + 1e-9) for x in scored)
    got = sorted((str(r.doc_id), str(r.lang), r.n_tokens, round(r.perplexity, 6), r.kept) for r in k.score(table, labels).collect())
    assert got == want and not all(w[-1] for w in want)


def test_clashing_names_and_a_long_text(spark):
    names = ["nats", "n", "s", "u", "v", "w", "threshold", "kept"]
    table = spark.createDataFrame([(i, "w1 w2 w3 " * (100_000 if i == 3 else 4), "en", *names) for i in range(12)], ["doc_id", "text", "lang", *names])
    labels = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int")
    assert sorted((r.doc_id, r.n_tokens) for r in k.score(table, labels).collect()) == [(i, 300_001 if i == 3 else 13) for i in range(12)]


def test_gibberish_is_dropped_and_clean_text_stays(spark, medium):
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    rows = k.score(docs, labels, 150).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in rows if r.quality == 0) > 5


def test_verdict_holds_with_the_parameters_of_the_query(spark, small, medium):
    for folder, dropped in ((small, 1), (medium, 20)):
        labels = spark.read.parquet(f"{folder}/labels.parquet")
        rows = k.op3_ngram_quality(spark, folder).join(labels, "doc_id").collect()
        good = [r for r in rows if r.quality == 1]
        assert all(math.isfinite(r.threshold) for r in rows)
        assert sum(r.kept for r in good) >= 0.97 * len(good)
        assert sum(not r.kept for r in rows if r.quality == 0) >= dropped


def test_a_part_of_the_trusted_documents_is_never_trained_on(spark):
    _, table, _ = tables(spark)
    for n in (2, 3, 60):
        labels = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
        assert 0 < k.train(table, labels)[2].count() < n
        assert all(math.isfinite(r.threshold) for r in k.score(table, labels).collect())


def test_all_trusted_documents_but_the_held_out_are_trained_on(spark):
    """More than 2,000 of them, with words that none but the last ones have."""
    docs = spark.createDataFrame([(i, f"w{i % 7} only{i} w{i % 5}", "en") for i in range(2600)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(2600)], "doc_id long, quality int")
    table, _, chosen = k.train(docs, labels)
    held = docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 1").count()
    assert chosen.count() == 2600 - held > 2000
    assert table.where("order = 1").count() == chosen.count() + 7 + 1 + 1  # own words, shared ones, the end and the beginning


def test_the_exchange_never_writes_the_model_and_gives_the_same_scores(spark, monkeypatch):
    """Also with buckets so small that frequent words are dealt by the word before, and with blocks of a few texts."""
    _, table, labels = tables(spark)
    rows = lambda **of: sorted((str(r.doc_id), r.n_tokens, r.perplexity, r.adjusted, r.kept) for r in k.score(table, labels, **of).collect())
    same = lambda got: all(g[:2] + g[4:] == w[:2] + w[4:] and g[2:4] == pytest.approx(w[2:4], rel=1e-9) for g, w in zip(got, want, strict=True))
    want = rows(broadcast_rows=10**9)
    monkeypatch.setattr(k, "train", None)
    assert same(rows(broadcast_rows=0))
    monkeypatch.setattr(k, "BLOCK_BYTES", 500)
    heavy, codes_for = [], k.codes_for
    monkeypatch.setattr(k, "codes_for", lambda *a: heavy.append(codes_for(*a)) or heavy[-1])
    assert same(rows(broadcast_rows=0, bucket_tokens=100))
    assert len(heavy[0].heavy) > 3 and heavy[0].buckets > 10


def test_too_many_words_for_the_exchange_take_the_join(spark, monkeypatch):
    _, table, labels = tables(spark)
    rows = lambda: sorted((str(r.doc_id), r.n_tokens, round(r.perplexity, 6), r.kept) for r in k.score(table, labels, broadcast_rows=0).collect())
    want = rows()
    monkeypatch.setattr(k, "VOCABULARY", 0)
    assert rows() == want
