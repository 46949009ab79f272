import hashlib

import pytest
from pyspark.sql import functions as F

from voxledger.__main__ import main
from voxledger.functions.spans import spans_of
from voxledger.operators import blocks, governance, headers, rules
from voxledger.plans import registry, scenario
from voxledger.sources import logs

VPL = "2025-01-15 10:00:00.000000 0% [INFO] source CallId=abc rest\nmore of it\n"
ORK = "2025-01-15T13:00:01.5+00:00 host proc[1]: INFO - lo.gger - CallId=abc\n"


def parsed(spark, tmp_path, app, text):
    (tmp_path / app).write_text(text)
    lines = logs.physical_lines(spark, str(tmp_path / app)).withColumns({"file_token": F.lit("<ARQUIVO_1>"), "app": F.lit(app)})
    return headers.parse_blocks(blocks.blocks(lines.withColumn("start_kind", blocks.start_kind(F.col("app"), F.col("text")))))


@pytest.mark.parametrize(("app", "text"), [("VPL", VPL), ("ORK", ORK), ("VPL", "2025-01-15 10:00:00.000 [INFO] s m\n"), ("ORK", "2025-01-15T10:00:00.1+00:00 | WARN | hi | there")])
def test_printing_gives_the_text_back(spark, tmp_path, app, text):
    row = parsed(spark, tmp_path, app, text).withColumn("printed", headers.print_entry()).first()
    assert row["printed"] == row["text"]


def test_spans_cut_out_the_fields(spark, tmp_path):
    for app, text in (("VPL", VPL), ("ORK", ORK)):
        row = parsed(spark, tmp_path, app, text).first()
        spans = spans_of(row["text"], row["format"], 5)
        assert {s["name"]: row["text"][s["span_start"] : s["span_end"]] for s in spans} == {f["name"]: f["value"] for f in row["fields"]}
        assert all(s["line_start"] == 5 for s in spans) and spans[-1]["line_end"] == 5 + text.count("\n") - 1
        for i in row["identifiers"]:
            assert row["text"][i["span_start"] : i["span_end"]] == i["original"]


def test_changed_files_are_left_out(spark, tmp_path):
    (tmp_path / "a").write_text("one\ntwo\n")
    (tmp_path / "b").write_text("x\ny\n")
    before = logs.file_digests(spark, str(tmp_path)).collect()
    before = spark.createDataFrame(before, "path string, size_bytes long, modificationTime timestamp, sha256 string")
    (tmp_path / "b").write_text("x\nY\n")
    changed = logs.changed_sources(before, logs.file_digests(spark, str(tmp_path)))
    assert [r["path"].rsplit("/")[-1] for r in changed.collect()] == ["b"]


def test_ranges_are_read_again_and_checked(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one\ntwo\r\nth\xffree\n")
    (tmp_path / "b").write_text("x\ny\n")
    lines = logs.physical_lines(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    told = {r["start_byte"]: r["bad_byte"] for r in lines.collect() if r["path"].endswith("a")}
    assert told == {0: None, 4: None, 9: 11}
    plan = lines._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan.split("== Physical Plan ==")[1]
    chosen = lines.select("path", F.concat(F.right("path", F.lit(1)), F.col("line_no").cast("string")).alias("entry_id"), "start_byte", "end_byte", "sha256").collect()
    chosen = spark.createDataFrame(chosen, "path string, entry_id string, start_byte long, end_byte long, sha256 string")
    (tmp_path / "b").write_text("x\nY\n")
    got = {r["entry_id"]: (r["text"], r["code"]) for r in logs.reread(chosen).collect()}
    assert got == {"a1": ("one\n", None), "a2": ("two\r\n", None), "a3": (None, None), "b1": ("x\n", None), "b2": (None, "SOURCE_CHANGED")}
    (tmp_path / "b").unlink()
    assert {r["code"] for r in logs.reread(chosen.where("entry_id like 'b%'")).collect()} == {"FILE_READ_ERROR"}


def test_artifacts(spark, tmp_path):
    for name in ("a.log", "b.log", "c.log"):
        (tmp_path / name).write_text(name)
    digest = hashlib.sha256(b"a.log").hexdigest()
    manifest = {"artifacts": [{"path": "a.log", "sha256": digest}, {"path": "b.log", "sha256": digest}, {"path": "d.log", "sha256": digest}]}
    got = {r["path"]: r["state"] for r in governance.compare_artifacts(spark, str(tmp_path), manifest).collect()}
    assert got == {"a.log": "ok", "b.log": "changed", "c.log": "undeclared", "d.log": "missing"}
    (tmp_path / "l.log").symlink_to(tmp_path / "a.log")
    (tmp_path / "x.bin").touch()
    assert dict(governance.artifact_files(str(tmp_path)))["l.log"] == "SYMLINK"
    assert dict(governance.artifact_files(str(tmp_path)))["x.bin"] == "EXTENSION"


def test_gates(spark):
    manifest = {k: "x" for k in governance.REQUIRED} | {"origin": "synthetic", "label": "SUCESSO", "artifacts": [{"path": "a.log", "sha256": "0"}]}
    extra = {"fixture_ids": ["f1"], "approved_by": "p", "approved_at": "t", "approval_reference": "r"}
    rule = rules.Rule("r", 1, "SUCESSO", ("VPL",), ({"condition_id": "c", "operator": "APPLICATION_PRESENT", "application": "VPL"},), 1, extra=extra)
    facts = spark.createDataFrame([("f1", "APPLICATION", "VPL", None, None, "application:VPL", None)], "fixture_id string, " + rules.FACTS_SCHEMA)
    bad = rules.Rule("bad", 1, "ERRO", ("ORK",), rule.conditions, 1, extra={"fixture_ids": ["f1", "f2"]})
    assert governance.gates([rule], {"f1": manifest}, facts) == {("r", 1): []}
    codes = governance.gates([rule, bad], {"f1": manifest | {"origin": "real"}}, facts, samples=2)
    assert codes["bad", 1] == ["FIXTURE_UNKNOWN", "ORIGIN_NOT_SANITIZED", "LABEL_MISMATCH", "APPROVAL_INCOMPLETE", "TOO_FEW_SAMPLES", "NO_LABELLED_ERROR", "FIXTURE_NAO_SATISFEITA", "FIXTURE_ERRO_SEGURO"]
    assert codes["r", 1] == ["ORIGIN_NOT_SANITIZED", "TOO_FEW_SAMPLES"] and governance.activated([rule, bad], codes) == set()
    known = governance.gates([rule, bad], {"f1": manifest}, facts, authorised={("bad", 1)})
    assert known == {("r", 1): [], ("bad", 1): []} and governance.activated([rule, bad], known) == {("r", 1), ("bad", 1)}
    assert governance.manifest_problems(manifest | {"artifacts": [{"path": "../x"}]}) == ["FORBIDDEN_PATH"]


def test_a_winner_needs_evidence_of_each_condition(spark):
    present = {"condition_id": "a", "operator": "APPLICATION_PRESENT", "application": "VPL"}
    nothing = {"condition_id": "b", "operator": "CARDINALITY", "target": "FACT", "comparison": "LT", "value": 5}
    rule = lambda i, *c: rules.Rule(i, 1, "CAT_" + i, ("VPL",), c, {"first": 1, "second": 2}[i])
    rows = [("s1", "APPLICATION", "VPL", None, None, "application:VPL", None), ("s2", "APPLICATION", "VPL", None, None, "application:VPL", None), ("s2", "FACT", "VPL", "f", None, "fact:1", None), ("s3", "APPLICATION", "ORK", None, None, "application:ORK", None)]
    facts = spark.createDataFrame(rows, "s string, " + rules.FACTS_SCHEMA)
    for first in (rule("first", nothing), rule("first", present, nothing)):
        own, by = [first, rule("second", present)], ("s",)
        got = {r["s"]: (r["category"], r["messages"]) for r in rules.classify(rules.evaluate(facts, own, by), False, rules.evidence(facts, own, by), by).collect()}
        assert got == {"s1": (rules.UNCLASSIFIED, [rules.NO_RULE, rules.NO_CAUSE]), "s2": ("CAT_first", [rules.NO_CAUSE]), "s3": (rules.UNCLASSIFIED, [rules.NO_RULE, rules.NO_CAUSE])}
        one = facts.where("s = 's1'").drop("s")
        assert rules.classify(rules.evaluate(one, own), False, rules.evidence(one, own)).first()["category"] == rules.UNCLASSIFIED
    blocked = facts.where("s = 's2'").select("s")
    got = {r["s"]: r["category"] for r in rules.classify(rules.evaluate(facts, own, by), blocked, None, by).collect()}
    assert got == {"s1": "CAT_first", "s2": rules.UNCLASSIFIED, "s3": rules.UNCLASSIFIED}
    assert rules.classify(rules.evaluate(one, [])).first()["category"] == rules.UNCLASSIFIED


def test_registry():
    r = registry.default_registry()
    assert r.ids() == ["ORK", "VOCI", "VPL"] and r.get("VPL").has_blocks and r.get("nope") is None
    with pytest.raises(ValueError, match="already"):
        r.add(r.get("ORK"))


def test_legacy_flow(spark, tmp_path):
    (tmp_path / "v").write_text("2024-01-15 10:00:01\tINFO\tcall ABC b\n2024-01-15 10:00:00\tINFO\tcall abc a\nno\n")
    rows, errors = scenario.legacy_entries(spark, [("VOCI", str(tmp_path / "v")), ("OTHER", str(tmp_path / "gone"))], "Abc")
    assert [r["message"] for r in rows.collect()] == ["call abc a", "call ABC b"]
    assert sorted((r["of"], r["description"]) for r in errors.collect()) == [("<ARQUIVO_2>", "FILE_UNAVAILABLE"), ("OTHER", "no entries")]
    assert not rows.first()["correlated"]


def test_command_line(capsys):
    assert main([]) == 1 and main(["x"]) == 1
    assert "APP:PATH" in capsys.readouterr().out


def test_manifests_are_read_with_and_without_a_mark(tmp_path):
    for name, data in (("a", b'\xef\xbb\xbf{"fixture_id": "f1"}'), ("b", b'{"fixture_id": "f2"}'), ("c", b'{"fixture_id": "f2"}'), ("d", b"\xff")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_bytes(data)
    found, problems = governance.read_manifests(str(tmp_path))
    assert list(found) == ["f1"]
    assert sorted(problems) == [("b/manifest.json", "DUPLICATE_FIXTURE"), ("c/manifest.json", "DUPLICATE_FIXTURE"), ("d/manifest.json", "MANIFEST_INVALID")]
