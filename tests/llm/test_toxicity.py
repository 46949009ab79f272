import numpy as np

from voxledger.llm import toxicity

DOCS = "doc_id long, text string, grade string, lang string"


def test_ordinal_fit_orders_thresholds_and_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 400)
    rows = np.repeat(np.arange(400), grade)
    cols = np.concatenate([rng.choice(6, g, replace=False) for g in grade])
    weights, thetas = toxicity.fit_ordinal(rows, cols, grade, 6, l2=0.1)
    assert np.all(np.diff(thetas) > 0) and np.all(weights > 0)
    score = np.bincount(rows, weights[cols], 400)
    expected = (1 / (1 + np.exp(thetas[None] - score[:, None]))).sum(axis=1)
    assert [expected[grade == g].mean() for g in range(4)] == sorted(expected[grade == g].mean() for g in range(4))


def test_held_out_accuracy(spark, medium):
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    train = labels.where("doc_id % 3 != 0")
    model = toxicity.train(docs, train)
    held = labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "truth")
    en = docs.where("lang = 'en'").select("doc_id")
    rows = toxicity.grades(docs, model).join(held, "doc_id").join(en, "doc_id").collect()
    assert len(rows) > 50
    assert sum(r.toxic == (r.truth == 1) for r in rows) / len(rows) > 0.95
    assert sum(r.toxic and r.truth == 0 for r in rows) == 0


def test_nulls_empties_ties_and_clashing_columns(spark):
    docs = [(i, ("nasty brute fool " if i % 2 else "kind gentle soul ") + f"word{i}", "x", "en") for i in range(40)]
    docs += [(100, None, "x", None), (101, "", "x", "en"), (None, "nasty brute fool", "x", "en"), (3, docs[3][1], "x", "en")]
    table = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(40)] + [(1, 0, 1), (None, 1, 1), (5, None, 1), (999, 1, 1)], "doc_id long, toxic int, grade int")
    model = toxicity.train(table, labels)
    out = toxicity.grades(table, model).collect()
    assert len(out) == len(docs)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add((r.toxic, r.expected_severity))
    assert len(by[3]) == 1
    assert not [1 for d in (100, 101) for t, _ in by[d] if t]
    assert all(t for t, _ in by[None] | by[1])
    kept = toxicity.drop_toxic(table, labels)
    assert kept.columns == table.columns and kept.count() == 22


def test_severity_follows_how_bad_a_text_is(spark):
    """Labels say only toxic or not; texts unseen in training get grades in the order of how many bad words they hold."""
    rng = np.random.default_rng(4)
    bad, good = [f"vile{chr(97 + i)}" for i in range(12)], [f"calm{chr(97 + i)}" for i in range(20)]

    def text(k):
        words = [*rng.choice(good, 15), *rng.choice(bad, k, replace=False)]
        return " ".join(rng.permutation(words))

    amount = [int(x) for x in rng.choice([0, 0, 0, 1, 2, 3, 5, 8, 11], 400)]
    table = spark.createDataFrame([(i, text(k), "x", "en") for i, k in enumerate(amount)], DOCS)
    labels = spark.createDataFrame([(i, int(k > 0)) for i, k in enumerate(amount) if i % 2], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.grades(table, toxicity.train(table, labels)).collect() if r.doc_id % 2 == 0}
    means = [np.mean([rows[i].expected_severity for i in rows if amount[i] == k]) for k in sorted(set(amount))]
    assert means == sorted(means) and means[0] < 0.3 and means[-1] > 2
    pairs = np.array([(amount[i], r.expected_severity) for i, r in rows.items()])
    ranks = pairs.argsort(axis=0, kind="stable").argsort(axis=0)
    assert np.corrcoef(ranks.T)[0, 1] > 0.9
    grades = {k: np.mean([rows[i].grade for i in rows if amount[i] == k]) for k in (0, 1, 11)}
    assert grades[0] < grades[1] < grades[11]


def test_query_against_plain(spark, small):
    """Scores of the query, recomputed from the model's weights document by document."""
    import math
    import re

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, small).collect()}
    assert len(got) == docs.count()
    for d in docs.collect():
        lowered = "".join(c.lower() if c.isascii() else c for c in d.text or "")
        words = {w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)}
        score = sum(model.weights.get(f, 0.0) for f in words | {b"^" + w[: toxicity.STEM] for w in words})
        p = [1 / (1 + math.exp(t - score)) for t in model.thetas]
        each = [1 - p[0], p[0] - p[1], p[1] - p[2], p[2]]
        r = got[d.doc_id]
        assert abs(r.expected_severity - sum(p)) < 1e-9 and r.toxic == (p[0] >= toxicity.REJECT) and r.grade == each.index(max(each))


def test_clashing_names_and_a_long_text(spark):
    names = ["p", "toxic", "features", "__id", "__text", "__toxic", "f"]
    table = spark.createDataFrame([(i, ("vile " if i % 2 else "calm ") * (300_000 if i == 5 else 3) + f"w{i}", *names) for i in range(40)], ["doc_id", "text", *names])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(table, labels)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == set(range(0, 40, 2))


def test_without_labels_nothing_is_toxic(spark):
    table = spark.createDataFrame([(1, "a b", "x", "en")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.toxic for r in toxicity.grades(table, toxicity.train(table, none)).collect()] == [False]
    assert toxicity.drop_toxic(table.limit(0), none).collect() == []


def test_the_bound_on_training_rows_is_kept(spark, monkeypatch):
    table = spark.createDataFrame([(i, "bad word" if i % 2 else "good word", "x", "en") for i in range(50)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda rows, cols, grade, n, real=toxicity.fit_ordinal: seen.append(len(grade)) or real(rows, cols, grade, n))
    toxicity.train(table, labels, per_class=5)
    assert seen == [10]
