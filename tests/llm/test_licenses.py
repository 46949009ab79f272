import numpy as np
import pytest

from voxledger.llm import licenses as c

DOCS = "doc_id long, text string, licenses string, n_paragraphs string"


@pytest.fixture(scope="module")
def model(spark, medium):
    return c.train(spark.read.parquet(f"{medium}/documents.parquet"))


def test_held_out_accuracy(model):
    prose = [[f"word{(i * j) % 91}".encode() for j in range(12)] for i in range(1, 60)]
    words, family, _ = c.training_set(prose, seed=99, per_template=10)
    p = model.probabilities(words)
    assert (np.argmax(p, axis=1) == family).mean() > 0.9
    assert np.allclose(p.sum(axis=1), 1)


@pytest.mark.parametrize(
    ("line", "family"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache"), ("released under the mit license", "mit"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY 4.0.", "cc-by"), ("Released under the Marmalade License.", None), ("He was released under the bridge.", None),
        ("Apache helicopters flew over the terms of the agreement", None),
    ],
)
def test_lines(model, line, family):
    found = c.scan([f"First prose line here.\n{line}\nLast one".encode()], model)[0]
    assert found["n_paragraphs"] == 3
    assert [(x["line"], x["family"]) for x in found["licenses"]] == ([(1, family)] if family else [])


def test_every_notice_of_the_corpus_is_found_and_no_other(spark, medium, model):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    known = {"Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "proprietary"}
    got = {r.doc_id: {x.family for x in r.licenses} for r in c.scan_documents(spark.read.parquet(f"{medium}/documents.parquet"), model).collect()}
    assert got == {d: {f for line, f in known.items() if line in t.split("\n")} for d, t in docs.items()}


BSD = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"]
GPL = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License."]
MIT = ["Permission is hereby granted, free of charge, to any person obtaining a", "copy of this software and associated documentation files"]


@pytest.mark.parametrize(("lines", "family"), [(BSD, "bsd"), (GPL, "gpl"), (MIT, "mit")])
def test_wrapped_notices(model, lines, family):
    text = "\n".join(["Some prose stands here first.", *lines, "", "And more prose follows the notice."])
    found = c.scan([text.encode()], model)[0]["licenses"]
    assert [x["family"] for x in found] == [family]
    assert 1 <= found[0]["line"] <= found[0]["line"] + found[0]["lines"] - 1 <= len(lines)
    apart = "\n\n".join(lines)  # blank lines part paragraphs
    assert all(x["lines"] == 1 for x in c.scan([apart.encode()], model)[0]["licenses"])


LONG = [(family, t) for family, ts in c.TEMPLATES.items() for t in ts if len(t.split()) >= 12]


@pytest.mark.parametrize("n", range(1, 13))
def test_notices_wrapped_over_any_number_of_lines(model, n):
    for family, template in LONG:
        words = template.split()
        cut = [" ".join(x) for x in np.array_split(words, n)]
        text = "\n".join(["Some prose stands here first.", *cut, "More prose follows it at once."])
        assert {x["family"] for x in c.scan([text.encode()], model)[0]["licenses"]} == {family}, (template, cut)


def test_templates_that_a_model_has_not_seen_stay_unknown_or_right(spark, medium):
    """Calibration is by template: models of one half of the templates, on the other half."""
    rows = spark.read.parquet(f"{medium}/documents.parquet").selectExpr("explode(split(text, '\n')) AS line").limit(1500).collect()
    words, family, half = c.training_set([p for r in rows if (p := r["line"].encode().translate(c.WORDS).split())])
    for part in (0, 1):
        seen, unseen = np.flatnonzero(half == part), np.flatnonzero(half != part)
        model = c.fit([words[i] for i in seen], family[seen])
        model.temperature = c.temperature(model, [words[i] for i in unseen], family[unseen])
        p = model.probabilities([words[i] for i in unseen])
        truth = family[unseen]
        sure = p.max(axis=1) >= 0.9
        assert (np.argmax(p, axis=1) == truth)[sure].mean() > 0.8
        assert (np.argmax(p, axis=1) == 0)[truth == 0].mean() > 0.9


def plain_scan(text, model):
    """The same by its definition: one line, then one run of lines, at a time."""
    lines = [p.split() for p in (text or b"").translate(c.WORDS).split(b"\n")]

    def probabilities(words):
        features, _ = c.paragraph_features([words])
        z = sum(model.weights[f].astype(float) for f in features) / np.sqrt(len(features)) + model.bias
        e = np.exp((z - z.max()) / model.temperature)
        return e / e.sum()

    def verdict(words):
        p = probabilities(words)
        k = 1 + int(np.argmax(p[1:]))
        pairs = set(zip(words, words[1:], strict=False))
        best = max(len(pairs & set(zip(t, t[1:], strict=False))) / len(set(zip(t, t[1:], strict=False))) for t in (x.encode().translate(c.WORDS).split() for x in c.TEMPLATES[c.FAMILIES[k]]))
        return (best, c.FAMILIES[k]) if p[k] >= c.MIN_PROBABILITY and best >= c.CONFIRM else None

    def share(words, template):
        return len(set(zip(words, words[1:], strict=False)) & template)

    def text(a, b):
        return [w for k in range(a, b + 1) for w in lines[k]]

    found = {(i, 1): v for i, w in enumerate(lines) if w and (v := verdict(w))}
    alone = {i for (i, _), v in found.items() if v[0] == 1}
    free = lambda k: 0 <= k < len(lines) and bool(lines[k]) and k not in alone
    runs = dict(found)
    for i, w in enumerate(lines):
        if not free(i) or probabilities(w)[1:].max() < c.SEED:
            continue
        for t in (x.encode().translate(c.WORDS).split() for ts in c.TEMPLATES.values() for x in ts):
            template, a, b = set(zip(t, t[1:], strict=False)), i, i
            while True:
                now = share(text(a, b), template)
                up = share(text(a - 1, b), template) - now if free(a - 1) else 0
                down = share(text(a, b + 1), template) - now if free(b + 1) else 0
                if not up and not down:
                    break
                a, b = (a - 1, b) if up >= down else (a, b + 1)
            if b > a and (v := verdict(text(a, b))):
                runs[a, b - a + 1] = v
    found = {}
    taken = set()
    for (a, n), (_, v) in sorted(runs.items(), key=lambda r: (-r[1][0], r[0][1], r[0][0])):
        if not taken.intersection(range(a, a + n)):
            found[a, n] = v
            taken.update(range(a, a + n))
    return sorted((a, n, v) for (a, n), v in found.items())


def test_query_against_plain(spark, small):
    """Every document of the smallest table, and texts with wrapped notices, against the plain version."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = c.train(docs)
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    got = {r.doc_id: sorted((x.line, x.lines, x.family) for x in r.licenses) for r in c.scan_documents(docs, model).collect()}
    assert got == {d: plain_scan(t, model) for d, t in texts.items()}
    odd = ["\n".join(x).encode() for x in (BSD, [*GPL, *MIT], ["Licensed under", "the MIT", "license."], [*BSD, "", *BSD], ["x", *MIT, "All rights reserved."])]
    for text, x in zip(odd, c.scan(odd, model), strict=True):
        assert sorted((y["line"], y["lines"], y["family"]) for y in x["licenses"]) == plain_scan(text, model)
    rows = {r.doc_id: (r.n_licenses, r.families) for r in c.op4_license_scan(spark, small).collect()}
    assert rows == {d: (len(v), ",".join(sorted({f for *_, f in v}))) for d, v in got.items()}


def test_nulls_empties_and_clashing_columns(spark, model):
    rows = [(None, None, "x", "y"), (1, "", "x", "y"), (2, "\n\n", "x", "y"), (3, "Released under the MIT License.", "x", "y"), (3, "Released under the MIT License.", "x", "y"), (4, "w " * 600_000 + "\nReleased under the MIT License.", "x", "y")]
    got = c.scan_documents(spark.createDataFrame(rows, DOCS), model).collect()
    assert sorted((str(r.doc_id), r.n_paragraphs, len(r.licenses)) for r in got) == [("1", 0, 0), ("2", 0, 0), ("3", 1, 1), ("3", 1, 1), ("4", 2, 1), ("None", 0, 0)]
    empty = spark.createDataFrame([], DOCS)
    assert c.scan_documents(empty, c.train(empty)).collect() == []
