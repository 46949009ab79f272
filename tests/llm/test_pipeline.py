"""The pipeline against a plain version, stage by stage: each stage is judged on its own input."""

import zlib

import numpy as np
import pytest
from test_decontaminate import plain as plain_matches
from test_mixing import plain_targets
from test_simhash import plain_components, plain_fingerprint

pipeline = pytest.importorskip("corpus_pipeline", reason="the pipeline has been removed")

from voxledger.llm import token_file, toxicity  # noqa: E402


def stage(name):
    return dict(pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    """The rows of documents and of every stage's result."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out, base = [docs.collect()], tmp_path_factory.mktemp("steps")
    for i, (_, f) in enumerate(pipeline.STAGES):
        f(spark, docs, small).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        out.append(docs.collect())
    return out


def test_stages_are_the_ones_asked_for():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing sources", "token ids"]


def test_all_stages_but_the_last_return_the_columns_of_documents(steps):
    assert all(list(rows[0].asDict()) == list(steps[0][0].asDict()) for rows in steps[:5])
    assert list(steps[5][0].asDict()) == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_toxicity(spark, small, steps):
    model = toxicity.train(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    want = [r for r in steps[0] if model.probabilities((r.text or "").encode())[0] < toxicity.REJECT]
    assert sorted(steps[1]) == sorted(want) and len(want) < len(steps[0])


def test_near_duplicates(steps):
    components = plain_components({r.doc_id: plain_fingerprint(r.text) for r in steps[1]})
    assert sorted(steps[2]) == sorted(r for r in steps[1] if components[r.doc_id] == r.doc_id)


def test_decontamination(spark, small, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    hit = {r.doc_id: plain_matches(r.text, items)[:2] for r in steps[2]}
    want = [r for r in steps[2] if not (hit[r.doc_id][1] > 0 and 20 * hit[r.doc_id][1] >= hit[r.doc_id][0])]
    assert sorted(steps[3]) == sorted(want)


def test_mixing(steps):
    size = lambda r: len((r.text or "").encode().split())
    sizes, taken = {}, {}
    for rows, into in ((steps[3], sizes), (steps[4], taken)):
        for r in rows:
            into[r.source] = into.get(r.source, 0) + size(r)
    longest = max(map(size, steps[3]))
    for source, target in plain_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 3 * longest
    copies = {}
    for r in steps[4]:
        copies[r] = copies.get(r, 0) + 1
    assert set(copies) <= set(steps[3]) and max(copies.values()) <= 3


def test_token_ids(steps):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_file.tokenizer_path())
    at, want = 0, []
    for r in sorted(steps[4], key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, steps[5])) == want


def test_run_equals_the_stages_and_leaves_no_inputs_behind(spark, small, steps):
    assert sorted(map(tuple, pipeline.run(spark, small).collect())) == sorted(map(tuple, steps[5]))


def test_nulls_ties_and_clashing_names_pass_every_stage(spark, small, tmp_path):
    names = ["row", "copies", "size", "match", "id", "hash", "n", "none", "h", "ids", "__keep", "__match", "__size"]
    texts = [None, "", "one", "A text of some words, said twice.", "A text of some words, said twice.", "x " * 50_000, *(f"text number {i} with words {i * i} and {i**3}" for i in range(12))]
    rows = [(None if i % 5 == 4 else i // 2, t, None if i % 7 == 6 else "en", None if i % 3 == 2 else "web", i, *names) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long"] + [f"{n} string" for n in names]))
    for table in (docs, docs.limit(0)):
        now = table
        for i, (_, f) in enumerate(pipeline.STAGES):
            out = f(spark, now, small)
            assert i == 4 or out.columns == docs.columns
            path = f"{tmp_path}/{table.count()}-{i}"
            out.write.parquet(path)
            now = spark.read.schema(out.schema).parquet(path)
        assert (now.count() > 0) == (table.count() > 0)
