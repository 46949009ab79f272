"""Fixtures and catalogue activation: declared against real artefacts, manifests, gates and explanations."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.operators.rules import Rule, evaluate

#: What a manifest must say, and which artefacts may be there.
REQUIRED = ("fixture_id", "origin", "sanitizer_version", "label", "validation_date", "approved_by", "artifacts")
ORIGINS = ("sanit", "synt", "sint")
EXTENSIONS = (".log", ".json", ".txt")
MAX_ARTIFACT = 16 * 1024 * 1024


def manifest_problems(manifest: dict) -> list[str]:
    """Codes of what a manifest lacks or says wrong."""
    missing = [f"MISSING_{k.upper()}" for k in REQUIRED if not manifest.get(k)]
    if manifest.get("origin") and not str(manifest["origin"]).casefold().startswith(ORIGINS):
        missing.append("ORIGIN_NOT_SANITIZED")
    paths = [a.get("path", "") for a in manifest.get("artifacts") or []]
    if len(set(paths)) < len(paths):
        missing.append("DUPLICATE_ARTIFACT")
    if any(Path(p).is_absolute() or ".." in Path(p).parts for p in paths):
        missing.append("FORBIDDEN_PATH")
    return missing


def read_manifests(root: str) -> tuple[dict[str, dict], list[tuple[str, str]]]:
    """Manifests below a folder by fixture, a leading byte order mark or not; and (path, problem) of those that
    can't be read or name a fixture that another one has too, neither of which then counts."""
    found, problems = {}, []
    for p in sorted(Path(root).rglob("manifest.json")):
        try:
            manifest = json.loads(p.read_bytes().decode("utf-8-sig"))
        except ValueError:
            manifest = None
        if p.is_symlink() or not isinstance(manifest, dict) or not isinstance(manifest.get("fixture_id"), str):
            problems.append((str(p.relative_to(root)), "MANIFEST_INVALID"))
        else:
            found.setdefault(manifest["fixture_id"], []).append((str(p.relative_to(root)), manifest))
    problems += [(path, "DUPLICATE_FIXTURE") for same in found.values() if len(same) > 1 for path, _ in same]
    return {f: same[0][1] for f, same in found.items() if len(same) == 1}, problems


def artifact_files(root: str) -> list[tuple[str, str | None]]:
    """(relative path, problem) of the files below a folder; links and unknown kinds are problems."""
    out = []
    for p in sorted(Path(root).rglob("*")):
        if p.is_symlink():
            out.append((str(p.relative_to(root)), "SYMLINK"))
        elif p.is_file():
            problem = "EXTENSION" if p.suffix not in EXTENSIONS else "TOO_LARGE" if p.stat().st_size > MAX_ARTIFACT else None
            out.append((str(p.relative_to(root)), problem))
    return out


def compare_artifacts(spark: SparkSession, root: str, manifest: dict) -> DataFrame:
    """path and state: ok, changed, missing or undeclared, from a full outer join on the path."""
    declared = spark.createDataFrame([(a["path"], a["sha256"]) for a in manifest["artifacts"]], "path string, declared string")
    base = "file:" + str(Path(root).resolve()) + "/"
    real = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.replace(F.url_decode("path"), F.lit(base), F.lit("")).alias("path"), F.sha2("content", 256).alias("real"))
    real = real.where(~F.col("path").endswith("manifest.json"))
    return compared(declared, real, "path").select("path", "state")


def compared(declared: DataFrame, real: DataFrame, key: str) -> DataFrame:
    """All columns of a full outer join on the key, with the state of each: ok or changed by the columns
    `declared` and `real` (two nulls are equal), missing or undeclared."""
    a, b = declared.withColumn("__a", F.lit(True)), real.withColumn("__b", F.lit(True))
    state = F.when(F.col("__a").isNull(), "undeclared").when(F.col("__b").isNull(), "missing").when(F.col("declared").eqNullSafe(F.col("real")), "ok").otherwise("changed")
    return a.join(b, key, "full").withColumn("state", state).drop("__a", "__b")


def gates(rules: list[Rule], manifests: dict[str, dict], facts: DataFrame, labelled_errors: int = 0, samples: int = 1, authorised: set[tuple[str, int]] | None = None) -> dict[tuple[str, int], list[str]]:
    """Codes that keep each rule from being activated: manifests, approval, samples, and its own fixtures, on which it must
    evaluate without error and be satisfied. `facts` are those of all fixtures (with fixture_id), and one evaluation
    tries all rules on all of them. Rules that were authorised before and haven't changed version skip the gates."""
    new = [r for r in rules if (r.rule_id, r.version) not in (authorised or set())]
    by = ("fixture_id",)
    # a row for each rule and fixture of a catalogue
    states = {(r["fixture_id"], r["rule_id"], r["version"]): r["state"] for r in evaluate(facts, new, by).collect()} if new else {}
    out: dict[tuple[str, int], list[str]] = {(r.rule_id, r.version): [] for r in rules}
    for rule in new:
        wanted = rule.extra.get("fixture_ids", ())
        own = [manifests.get(f) for f in wanted]
        codes = ["FIXTURE_UNKNOWN"] if not own or None in own else []
        own = [m for m in own if m]
        codes += sorted({p for m in own for p in manifest_problems(m)})
        if any(m.get("label") != rule.category for m in own):
            codes.append("LABEL_MISMATCH")
        if not all(rule.extra.get(k) for k in ("approved_by", "approved_at", "approval_reference")):
            codes.append("APPROVAL_INCOMPLETE")
        if len(own) < samples:
            codes.append("TOO_FEW_SAMPLES")
        if (rule.root_cause or rule.category == "ERRO") and labelled_errors < 1:
            codes.append("NO_LABELLED_ERROR")
        tried = [states.get((f, rule.rule_id, rule.version), "ERRO_SEGURO") for f in wanted]
        out[rule.rule_id, rule.version] = codes + [f"FIXTURE_{s}" for s in tried if s != "SATISFEITA"]
    return out


def activated(rules: list[Rule], codes: dict[tuple[str, int], list[str]]) -> set[tuple[str, int]]:
    """The rules that may be used: active ones that nothing keeps back; none if any active one is kept back."""
    active = {(r.rule_id, r.version) for r in rules if r.state == "ACTIVE"}
    return active if all(not codes.get(k, ["UNKNOWN"]) for k in active) else set()


def diversity(samples: DataFrame, dimensions: list[str]) -> DataFrame:
    """Distinct values of each dimension, and the number of samples."""
    return samples.agg(*[F.count_distinct(d).alias(d) for d in dimensions], F.count(F.lit(1)).alias("samples"))
