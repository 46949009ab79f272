"""Declarative rules over a scenario: conditions, conjunctions, precedence, and the catalogue they come from.

Facts about scenarios are one table (kind, app, name, value, ref, utc, and what tells scenarios apart): applications,
entries, fields, links and facts. Every condition is an aggregate over it, so all conditions of all rules over all
scenarios take one pass, and one more finds the evidence of each condition.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Catalogue limits, codes and states.
MAX_BYTES, MAX_TEXT, MAX_DEPTH, MAX_LIST, MAX_KEYS = 5 * 1024 * 1024, 16_384, 16, 1024, 256
IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9._:-]{0,127}")
STATES = ("DRAFT", "CANDIDATE", "APPROVED", "ACTIVE", "RETIRED")
COMPARISONS = {"EQ": "=", "GTE": ">=", "LTE": "<=", "GT": ">", "LT": "<", "EXACTLY": "=", "AT_LEAST": ">=", "AT_MOST": "<="}
PARAMETERS = {
    "APPLICATION_PRESENT": {"application"}, "FIELD_PRESENT": {"field", "application"}, "FIELD_EQUALS": {"field", "application", "expected"},
    "LINK_PRESENT": {"relation", "schema_id", "schema_version", "source_type", "target_type", "allows_correlation"}, "EXPLICIT_LINK_PRESENT": {"relation", "schema_id", "schema_version", "source_type", "target_type", "allows_correlation"},
    "FACT_PRESENT": {"fact", "application"}, "CARDINALITY": {"target", "comparison", "value", "application", "field", "relation", "fact"}, "TEMPORAL_ORDER": {"before", "after", "allow_equal"},
}
REQUIRED = {"APPLICATION_PRESENT": {"application"}, "LINK_PRESENT": {"relation"}, "EXPLICIT_LINK_PRESENT": {"relation"}, "FIELD_PRESENT": {"field"}, "FIELD_EQUALS": {"field", "expected"}, "FACT_PRESENT": {"fact"}, "CARDINALITY": {"target", "comparison", "value"}, "TEMPORAL_ORDER": {"before", "after"}}
UNCLASSIFIED = "NAO_CLASSIFICADA"
#: Categories, and the keys that each part of a catalogue must and may have.
CATEGORIES = ("SUCESSO", "ERRO", UNCLASSIFIED)
APPROVAL = {"approved_by", "approved_at", "approval_reference"}
KEYS = {
    "catalog": ({"schema_version", "catalog_version", "coverage", "rules"}, {"fixtures", "gaps", "precedence", "catalog_digest"}),
    "rule": ({"rule_id", "version", "category", "applications", "conditions", "fixture_ids", "fixture_digests", "state", "precedence"}, {"approval", "evidence_selectors", "digest", "root_cause", "causa_raiz"} | APPROVAL),
    "coverage": ({"labeled_successes", "labeled_errors"}, {"statement", "gaps"}),
    "gap": ({"gap_id", "description"}, set()),
    "fixture": ({"fixture_id", "label", "sanitized_origin", "validated_at", "validated_by"}, {"digest", "sha256", "sanitizer_version"}),
    "precedence": ({"rule_id", "version", "precedence"}, set()),
    "approval": (APPROVAL, set()),
}
#: The gap that every catalogue has.
DEFAULT_GAP = ("ADDITIONAL_LABELED_SUCCESS_AND_ERROR_SAMPLES", "Amostras adicionais rotuladas de sucesso e erro são necessárias para generalizar padrões além do cenário atualmente coberto.")


class CatalogError(ValueError):
    """A catalogue that can't be used; the code says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Rule:
    rule_id: str
    version: int
    category: str
    applications: tuple[str, ...]
    conditions: tuple[dict, ...]
    precedence: int
    state: str = "ACTIVE"
    root_cause: str | None = None
    extra: dict = field(default_factory=dict, compare=False, hash=False)


def canonical_digest(document: dict, leave_out: tuple[str, ...] = ()) -> str:
    """SHA-256 of the document in sorted, compact JSON."""
    kept = {k: v for k, v in document.items() if k not in leave_out}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _no_duplicates(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise CatalogError("CATALOG_JSON_ERROR", "duplicate key")
    return dict(pairs)


def _no_constants(name: str) -> None:
    raise CatalogError("CATALOG_JSON_ERROR", name)


def _bounded(value: object, depth: int = 1) -> None:
    if depth > MAX_DEPTH or (isinstance(value, str) and len(value) > MAX_TEXT) or (isinstance(value, list) and len(value) > MAX_LIST) or (isinstance(value, dict) and len(value) > MAX_KEYS):
        raise CatalogError("CATALOG_SIZE_ERROR")
    for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _bounded(x, depth + 1)


@dataclass(frozen=True)
class Catalog:
    """A sound catalogue; its rules are in order of id and version, its gaps in order of id."""

    version: str
    rules: tuple[Rule, ...]
    statement: str
    gaps: tuple[tuple[str, str], ...]
    digest: str


def _need(sound: object, code: str = "CATALOG_SCHEMA_ERROR") -> None:
    if not sound:
        raise CatalogError(code)


def _part(value: object, name: str) -> dict:
    """A part of a catalogue with the keys it must have and no others than it may have."""
    must, may = KEYS[name]
    _need(isinstance(value, dict) and must <= value.keys() <= must | may)
    return value  # type: ignore[return-value]


def _number(value: object, least: int = 0) -> bool:
    return type(value) is int and value >= least


def coverage_statement(successes: int, errors: int) -> str:
    """The sentence that says how many labelled scenarios of either kind there are."""
    noun = lambda n: "cenário" if n == 1 else "cenários"
    return f"{successes} {noun(successes)} de sucesso; {errors} {noun(errors)} de erro"


def _gaps(values: list) -> tuple[tuple[str, str], ...]:
    found = []
    for v in values:
        if isinstance(v, str):  # a gap given by its text alone: the text names it, or its digest does
            found.append((v if IDENTIFIER.fullmatch(v) else "GAP_" + hashlib.sha256(v.encode()).hexdigest()[:16], v))
        else:
            found.append((_part(v, "gap")["gap_id"], v["description"]))
    _need(len(dict(found)) == len(found), "CATALOG_REFERENCE_ERROR")
    return tuple(sorted({DEFAULT_GAP[0]: DEFAULT_GAP[1], **dict(found)}.items()))


def _rule(value: object) -> Rule:
    r = _part(value, "rule")
    flat = APPROVAL & r.keys()
    _need(bool(flat) != ("approval" in r) and flat in (set(), APPROVAL))
    approval = _part(r["approval"], "approval") if "approval" in r else r
    lists = [r[k] for k in ("applications", "conditions", "fixture_ids")]
    _need(all(isinstance(x, list) for x in lists) and r["applications"] and r["state"] in STATES and r["category"] in CATEGORIES)
    _need(isinstance(r["rule_id"], str) and IDENTIFIER.fullmatch(r["rule_id"]) and _number(r["version"], 1) and _number(r["precedence"]) and all(isinstance(c, dict) for c in r["conditions"]))
    _need("digest" not in r or r["digest"] == canonical_digest(r, ("digest",)), "CATALOG_DIGEST_ERROR")
    cause = r.get("root_cause", r.get("causa_raiz"))
    return Rule(r["rule_id"], r["version"], r["category"], tuple(r["applications"]), tuple(r["conditions"]), r["precedence"], r["state"], cause, r | {k: approval[k] for k in APPROVAL})


def parse_catalog(data: bytes) -> Catalog:
    """A catalogue document: strict UTF-8 JSON within limits, no unknown keys, unique rules, and what it says twice
    (digests, coverage sentence, precedences) said alike. The default gap is always there."""
    _need(len(data) <= MAX_BYTES, "CATALOG_SIZE_ERROR")
    try:
        doc = json.loads(data.decode("utf-8"), object_pairs_hook=_no_duplicates, parse_constant=_no_constants)
    except UnicodeDecodeError as e:
        raise CatalogError("CATALOG_ENCODING_ERROR") from e
    except json.JSONDecodeError as e:
        raise CatalogError("CATALOG_JSON_ERROR") from e
    _bounded(doc)
    _need(isinstance(doc, dict))
    _need("schema_version" in doc, "CATALOG_VERSION_ERROR")
    _part(doc, "catalog")
    _need(type(doc["schema_version"]) is int and doc["schema_version"] == 1, "CATALOG_VERSION_ERROR")
    _need(isinstance(doc["catalog_version"], str) and IDENTIFIER.fullmatch(doc["catalog_version"]) and isinstance(doc["rules"], list))
    coverage = _part(doc["coverage"], "coverage")
    _need(all(isinstance(x, list) for x in (coverage.get("gaps", []), *(doc.get(k, []) for k in ("gaps", "fixtures", "precedence")))))
    counts = coverage["labeled_successes"], coverage["labeled_errors"]
    _need(all(map(_number, counts)))
    statement = coverage_statement(*counts)
    _need(coverage.get("statement", statement) == statement)
    gaps = _gaps([*coverage.get("gaps", []), *doc.get("gaps", [])])
    rules = sorted(map(_rule, doc["rules"]), key=lambda r: (r.rule_id, r.version))
    order = {(r.rule_id, r.version): r.precedence for r in rules}
    _need(len(order) == len(rules), "CATALOG_REFERENCE_ERROR")
    fixtures = [_part(f, "fixture") for f in doc.get("fixtures", [])]
    _need(all(("digest" in f) != ("sha256" in f) for f in fixtures), "CATALOG_DIGEST_ERROR")
    _need(len({f["fixture_id"] for f in fixtures}) == len(fixtures), "CATALOG_REFERENCE_ERROR")
    if "precedence" in doc:
        said = [(p["rule_id"], p["version"], p["precedence"]) for p in (_part(x, "precedence") for x in doc["precedence"])]
        _need({(i, v): n for i, v, n in said} == order and len(said) == len(order), "CATALOG_REFERENCE_ERROR")
    digest = canonical_digest(doc, ("catalog_digest",))
    _need(doc.get("catalog_digest", digest) == digest, "CATALOG_DIGEST_ERROR")
    return Catalog(doc["catalog_version"], tuple(rules), statement, gaps, digest)


def load_catalog(data: bytes) -> list[Rule]:
    """The rules of a sound catalogue document."""
    return list(parse_catalog(data).rules)


def read_catalog(path: str) -> Catalog:
    """The catalogue in a regular file."""
    try:
        _need(os.path.isfile(path), "CATALOG_FILE_ERROR")
        _need(os.path.getsize(path) <= MAX_BYTES, "CATALOG_SIZE_ERROR")
        with open(path, "rb") as f:
            return parse_catalog(f.read())
    except OSError as e:
        raise CatalogError("CATALOG_FILE_ERROR") from e


def check_history(old: list[Rule], new: list[Rule]) -> None:
    """A published rule never changes or disappears, and what is new of it has a higher version."""
    now = {(r.rule_id, r.version): r for r in new}
    before = {(r.rule_id, r.version) for r in old}
    last: dict[str, int] = {}
    for r in old:
        last[r.rule_id] = max(r.version, last.get(r.rule_id, 0))
    changed = any(now.get((r.rule_id, r.version)) != r for r in old)
    if changed or any(v <= last.get(i, 0) for i, v in now.keys() - before):
        raise CatalogError("CATALOG_HISTORY_ERROR")


def check_succession(old: Catalog, new: Catalog) -> None:
    """A catalogue that may follow a published one: its history is kept, and what differs has another version."""
    check_history(list(old.rules), list(new.rules))
    _need(new.version != old.version or new == old, "CATALOG_VERSION_ERROR")


def usable(rules: list[Rule], authorised: set[tuple[str, int]] | None = None) -> list[Rule]:
    """The active rules in order of precedence, checked anew before use. No rule may be used if one is wrong:
    repeated, of an equal precedence, of no category, with a cause that isn't an error's, or if not exactly the
    active ones are authorised (where that is said)."""
    active = sorted((r for r in rules if r.state == "ACTIVE"), key=lambda r: (r.precedence, r.rule_id, r.version))
    sound = len({(r.rule_id, r.version) for r in rules}) == len(rules) and len({r.precedence for r in active}) == len(active)
    sound = sound and all(_number(r.version, 1) and _number(r.precedence) and r.category != UNCLASSIFIED and (r.root_cause is None or r.category == "ERRO") for r in active)
    if authorised is not None:
        sound = sound and authorised == {(r.rule_id, r.version) for r in active}
    return active if sound else []


# ---------------------------------------------------------------- conditions

FACTS_SCHEMA = "kind string, app string, name string, value string, ref string, utc timestamp"


def scenario_facts(entries: DataFrame, edges: DataFrame | None = None, facts: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The fact table of entries (entry_id, app, timestamp_utc, fields), links and given facts; the columns `by`, which
    all of them have, tell scenarios apart."""
    none = F.lit(None).cast("string")
    when, never = F.col("timestamp_utc"), F.lit(None).cast("timestamp").alias("utc")
    out = entries.select(*by, F.lit("APPLICATION").alias("kind"), "app", none.alias("name"), none.alias("value"), F.concat(F.lit("application:"), "app").alias("ref"), never).distinct()
    out = out.unionByName(entries.select(*by, F.lit("ENTRY").alias("kind"), "app", F.col("entry_id").alias("name"), none.alias("value"), F.concat(F.lit("entry:"), "entry_id").alias("ref"), when.alias("utc")))
    f = entries.select(*by, "app", "entry_id", when.alias("utc"), F.posexplode("fields").alias("i", "f"))
    out = out.unionByName(f.select(*by, F.lit("FIELD").alias("kind"), "app", F.col("f.name").alias("name"), F.col("f.value").alias("value"), F.concat_ws(":", F.lit("field"), "entry_id", "i").alias("ref"), "utc"))
    if edges is not None:
        good = edges.where("not ambiguous")
        ends = [(F.col(c) if c in edges.columns else none).alias(name) for c, name in (("src_type", "source_type"), ("dst_type", "target_type"))]
        out = out.unionByName(good.select(*by, F.lit("LINK").alias("kind"), none.alias("app"), F.col("relation").alias("name"), F.to_json(F.struct("schema_id", "schema_version", "allows_correlation", *ends)).alias("value"), F.concat_ws(":", F.lit("link"), "src", "dst", "relation").alias("ref"), never))
    if facts is not None:
        out = out.unionByName(facts.select(*by, F.lit("FACT").alias("kind"), "app", "name", none.alias("value"), F.concat_ws(":", F.lit("fact"), "app", "name", "entry_id").alias("ref"), "utc"))
    return out


def _is(kind: str, **wanted: object) -> Column:
    test = F.col("kind") == kind
    for column, value in wanted.items():
        if value is not None:
            test = test & (F.col(column) == F.lit(value))
    return F.coalesce(test, F.lit(False))


def _link(c: dict) -> Column:
    test = _is("LINK", name=c.get("relation"))
    for key in ("schema_id", "schema_version", "source_type", "target_type", "allows_correlation"):
        if key in c:
            test = test & (F.get_json_object("value", f"$.{key}") == F.lit(str(c[key]).lower() if isinstance(c[key], bool) else str(c[key])))
    return test


def _selector(s: dict) -> Column:
    if "entry_id" in s:
        return _is("ENTRY", name=s["entry_id"])
    if "fact" in s:
        return _is("FACT", name=s["fact"], app=s.get("application"))
    return _is("ENTRY", app=s["application"])


def condition_error(c: dict) -> str | None:
    """The code of a condition that can't be evaluated."""
    op = c.get("operator")
    if op not in PARAMETERS:
        return "UNKNOWN_OPERATOR"
    given = set(c) - {"condition_id", "operator"}
    if given - PARAMETERS[op]:
        return "UNKNOWN_PARAMETER"
    if REQUIRED.get(op, set()) - given:
        return "MISSING_PARAMETER"
    if op == "CARDINALITY" and (c["comparison"] not in COMPARISONS or c["target"] not in ("APPLICATION", "ENTRY", "FIELD", "LINK", "FACT") or not isinstance(c["value"], int)):
        return "INVALID_PARAMETER"
    return None


def condition(c: dict) -> Column:
    """An aggregate over the fact table: is the condition satisfied?"""
    op, app = c["operator"], c.get("application")
    if op == "APPLICATION_PRESENT":
        return F.count_if(_is("APPLICATION", app=app)) > 0
    if op in ("FIELD_PRESENT", "FIELD_EQUALS"):
        return F.count_if(_is("FIELD", name=c["field"], app=app, value=c.get("expected"))) > 0
    if op in ("LINK_PRESENT", "EXPLICIT_LINK_PRESENT"):
        return F.count_if(_link(c)) > 0
    if op == "FACT_PRESENT":
        return F.count_if(_is("FACT", name=c["fact"], app=app)) > 0
    if op == "CARDINALITY":
        chosen = _link(c) if c["target"] == "LINK" else _is(c["target"], app=app, name=c.get("field") if c["target"] == "FIELD" else c.get("fact") if c["target"] == "FACT" else None)
        n = F.count_distinct(F.when(chosen, F.col("ref")))
        return {"=": n == c["value"], ">=": n >= c["value"], "<=": n <= c["value"], ">": n > c["value"], "<": n < c["value"]}[COMPARISONS[c["comparison"]]]
    before, after = _selector(c["before"]), _selector(c["after"])
    last, first = F.max(F.when(before, F.col("utc"))), F.min(F.when(after, F.col("utc")))
    undated = F.count_if((before | after) & F.col("utc").isNull()) > 0
    ordered = last <= first if c.get("allow_equal") else last < first
    return ~undated & F.coalesce(ordered, F.lit(False))


def concerns(c: dict) -> Column:
    """Row by row: is a fact one that the condition, if satisfied, rests on?"""
    op, app = c["operator"], c.get("application")
    if op == "APPLICATION_PRESENT":
        return _is("APPLICATION", app=app)
    if op in ("FIELD_PRESENT", "FIELD_EQUALS"):
        return _is("FIELD", name=c["field"], app=app, value=c.get("expected"))
    if op == "FACT_PRESENT":
        return _is("FACT", name=c["fact"], app=app)
    if op == "TEMPORAL_ORDER":
        return _selector(c["before"]) | _selector(c["after"])
    if op == "CARDINALITY" and c["target"] != "LINK":
        return _is(c["target"], app=app, name=c.get("field") if c["target"] == "FIELD" else c.get("fact") if c["target"] == "FACT" else None)
    return _link(c)


def _flaw(r: Rule) -> str | None:
    """The code of what keeps a rule from being evaluated."""
    ids = [c.get("condition_id") for c in r.conditions]
    codes = [e for c in r.conditions if (e := condition_error(c))] + (["NO_CONDITIONS"] if not ids else []) + (["DUPLICATE_CONDITION"] if len(set(ids)) < len(ids) else [])
    return min(codes, default=None)


def evidence(facts: DataFrame, rules: list[Rule], by: tuple[str, ...] = ()) -> DataFrame:
    """What each condition of each rule rests on, scenario by scenario: by, rule_id, version, condition_id, n_evidence and
    ref (the least). One pass for all rules; conditions without evidence have no row."""
    hits = [
        F.when(F.coalesce(concerns(c), F.lit(False)), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.version).alias("version"), F.lit(c["condition_id"]).alias("condition_id")))
        for r in rules if _flaw(r) is None for c in r.conditions
    ]
    none = F.array().cast("array<struct<rule_id: string, version: int, condition_id: string>>")
    each = facts.select(*by, "ref", F.explode(F.array_compact(F.array(*hits)) if hits else none).alias("c")).select(*by, "c.*", "ref").distinct()
    return each.groupBy(*by, "rule_id", "version", "condition_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.min("ref").alias("ref"))


def evaluate(facts: DataFrame, rules: list[Rule], by: tuple[str, ...] = ()) -> DataFrame:
    """by, rule_id, version, precedence, category, root_cause, conditions (how many), error and state of evaluation:
    SATISFEITA, NAO_SATISFEITA or ERRO_SEGURO. A row for each rule and scenario; without rules one of nulls."""
    present = F.collect_set(F.when(F.col("kind") == "APPLICATION", F.col("app")))
    tests, rows = [], []
    for i, r in enumerate(rules):
        error, met = _flaw(r), F.lit(False)
        if error is None:
            test = F.size(F.array_except(F.array(*[F.lit(a) for a in r.applications]).cast("array<string>"), present)) == 0
            for c in r.conditions:
                test = test & condition(c)
            tests.append(test.alias(f"r{i}"))
            met = F.coalesce(F.col(f"r{i}"), F.lit(False))
        state = F.lit("ERRO_SEGURO") if error else F.when(met, "SATISFEITA").otherwise("NAO_SATISFEITA")
        told = {"rule_id": r.rule_id, "version": r.version, "precedence": r.precedence, "category": r.category, "root_cause": r.root_cause, "conditions": len(r.conditions), "error": error}
        kinds = {"version": "int", "precedence": "int", "conditions": "int"}
        rows.append(F.struct(*[F.lit(v).cast(kinds.get(k, "string")).alias(k) for k, v in told.items()], state.alias("state")))
    one = facts.groupBy(*by).agg(*(tests or [F.count(F.lit(1)).alias("__n")]))
    none = F.array().cast("array<struct<rule_id: string, version: int, precedence: int, category: string, root_cause: string, conditions: int, error: string, state: string>>")
    return one.select(*by, F.explode_outer(F.array(*rows) if rows else none).alias("r")).select(*by, "r.*")


#: What an explanation says where it has no more to say.
NO_RULE, NO_CAUSE = "NENHUMA_REGRA_VALIDADA_CORRESPONDEU", "CAUSA_RAIZ_NAO_DETERMINADA"


def classify(evaluated: DataFrame, ambiguous: bool | DataFrame = False, found: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by, category, rule_id, version, root_cause and messages: a row for each scenario, by its satisfied rule of least
    (precedence, id, version).

    Any error, or ambiguity in the scenario (`ambiguous`, or a table of such scenarios), leaves it unclassified. So does
    a winner one of whose conditions has no evidence in `found` (of evidence()): no other rule takes its place.
    """
    best = F.min(F.when(F.col("state") == "SATISFEITA", F.struct("precedence", "rule_id", "version", "category", "root_cause", "conditions")))
    safe = F.count_if(F.col("state") == "ERRO_SEGURO") == 0
    if ambiguous is True:
        safe = F.lit(False)
    won = evaluated.groupBy(*by).agg(F.when(safe, best).alias("w"))
    if isinstance(ambiguous, DataFrame):
        won = won.join(ambiguous.select(*by).distinct().withColumn("__no", F.lit(True)), list(by), "left").select(*by, F.when(F.col("__no").isNull(), F.col("w")).alias("w"))
    if found is not None:
        told = found.groupBy(*by, F.col("rule_id").alias("__rule"), F.col("version").alias("__version")).agg(F.count(F.lit(1)).alias("__n"))
        same = (F.col("w.rule_id") == F.col("__rule")) & (F.col("w.version") == F.col("__version"))
        for c in by:
            told = told.withColumnRenamed(c, f"__{c}")
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        whole = F.coalesce(F.col("__n") == F.col("w.conditions"), F.lit(False))
        won = won.join(told, same, "left").select(*by, F.when(whole, F.col("w")).alias("w"))
    messages = F.array_compact(F.array(F.when(F.col("w").isNull(), NO_RULE), F.when(F.col("w.root_cause").isNull(), NO_CAUSE)))
    return won.select(*by, F.coalesce("w.category", F.lit(UNCLASSIFIED)).alias("category"), F.col("w.rule_id").alias("rule_id"), F.col("w.version").alias("version"), F.col("w.root_cause").alias("root_cause"), messages.alias("messages"))
