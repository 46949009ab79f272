"""The scenario query: every entry of one call across applications, what links them, and what it amounts to."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.functions.identifiers import check_query, normalize_query
from voxledger.functions.store import materialize, remove, shared_dir, within
from voxledger.functions.temporal import NO_OFFSET, utc_text
from voxledger.operators import blocks, correlate, graph, headers, rules, scanner, search, secure, timeline
from voxledger.operators.summaries import placeholder_type
from voxledger.plans.registry import Registry, default_registry
from voxledger.sources import logs


#: Fixed value: the code of files whose application nothing parses.
UNREGISTERED = "APPLICATION_NOT_REGISTERED"
#: Fixed value: what takes the place of a report that isn't safe.
UNSAFE = "SANITIZATION_ERROR"


def parse_files(spark: SparkSession, files: list[tuple[str, str]], registry: Registry | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(entries, errors) of (app, path) pairs. One bad file, line or block never stops the others. Of a path that is
    given several times the last application counts; an application that isn't registered is an error row."""
    registry = registry or default_registry()
    last = {path: app for app, path in files}
    sources, errors = logs.preflight(spark, [(app, path) for path, app in last.items()])
    known = sources.collect()  # at most one row for each of MAX_FILES files
    strange = [(r["file_token"], r["app"], UNREGISTERED) for r in known if registry.get(r["app"]) is None]
    if strange:
        errors = errors.unionByName(spark.createDataFrame(strange, logs.ERRORS_SCHEMA))
    entries = None
    for app_id in sorted({r["app"] for r in known}):
        app = registry.get(app_id)
        if app is None:
            continue
        own = sources.where(F.col("app") == app_id).select("file_token", "app", F.col("path").alias("place"))
        lines = logs.physical_lines(spark, [r["path"] for r in known if r["app"] == app_id])
        lines = lines.withColumn("place", F.regexp_replace(F.url_decode(F.col("path")), r"^file:/*", "/")).join(F.broadcast(own), "place")
        if app.has_blocks:
            parsed = app.parse(blocks.blocks(blocks.with_start_kind(lines)))
        else:
            parsed = line_entries(app.parse(lines))
        parsed = parsed.withColumn("category", app.category())
        entries = parsed if entries is None else entries.unionByName(parsed, allowMissingColumns=True)
    return entries, errors


def line_entries(lines: DataFrame) -> DataFrame:
    """Parsed lines as entries of one line each: their times have no zone, so they are undated."""
    number = F.regexp_extract("file_token", r"(\d+)", 1)
    fields = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in (("timestamp", "timestamp_original"), ("severidade", "level"), ("mensagem", "message"))])
    none = F.array().cast("array<struct<type:string,namespace:string,field:string,original:string,normalized:string,rule:string,span_start:int,span_end:int,line_offset:int>>")
    failure = F.when(F.col("text").isNull(), headers.INVALID_UTF8).when(~F.col("interpreted"), F.concat("app", F.lit("_LINHA_NAO_INTERPRETADA"))).otherwise(NO_OFFSET)
    place = (F.col("line_no") - 1).cast("long")
    return lines.select(
        "file_token", "app", F.concat(F.lit("ARQUIVO_"), number, F.lit("_ENTRADA_"), place.cast("string")).alias("entry_id"), place.alias("read_order"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"),
        "start_byte", "end_byte", F.concat("text", "terminator").alias("text"), F.when(F.col("interpreted"), F.lower("app")).alias("format"), "interpreted", "level", "message", "timestamp_original",
        F.lit(None).cast("timestamp").alias("timestamp_utc"), F.lit(None).cast("int").alias("precision"), F.when(F.col("interpreted"), fields).otherwise(fields.cast("array<struct<name:string,value:string>>")).alias("fields"),
        none.alias("identifiers"), F.array(failure).alias("failures"),
    )


def answer(
    spark: SparkSession, query: str, files: list[tuple[str, str]], catalog: list[rules.Rule] | None = None, links: DataFrame | None = None, registry: Registry | None = None,
    schemas: list[graph.LinkSchema] | None = None, authorised: set[tuple[str, int]] | None = None,
) -> Scenario:
    """Answer one identifier over some files. The query is checked before anything is read."""
    if problem := check_query(query):
        raise ValueError(problem)
    entries, errors = parse_files(spark, files, registry)
    if entries is None:
        raise ValueError("NO_READABLE_FILE")
    places = spark.createDataFrame([(f"<ARQUIVO_{i}>", path) for i, path in enumerate({path: app for app, path in files}, 1)], "file_token string, path string")
    return analyse(spark, query, entries, errors, catalog, links, schemas, authorised, places)


def analyse(
    spark: SparkSession, query: str, entries: DataFrame, errors: DataFrame | None = None, catalog: list[rules.Rule] | None = None, links: DataFrame | None = None,
    schemas: list[graph.LinkSchema] | None = None, authorised: set[tuple[str, int]] | None = None, places: DataFrame | None = None,
) -> Scenario:
    """The answer to one identifier from parsed entries. Its parts are made when they are asked for.

    `links` are recognised edges (see graph.recognise) between identifier nodes; `schemas` recognise them in the entries
    themselves. Without any, only shared values correlate. `authorised` names the rules that have passed the gates;
    places (file_token, path) are hidden like other values.
    """
    if problem := check_query(query):
        raise ValueError(problem)
    errors = errors if errors is not None else spark.createDataFrame([], logs.ERRORS_SCHEMA)
    return Scenario(spark, query, entries, errors, catalog or [], links, schemas or [], authorised, places)


def _part(make: Callable[[Scenario], object]) -> cached_property:
    """A part of an answer: made once, when it is asked for; tables on the way are in the answer's folder."""

    def run(self: Scenario) -> object:
        with within(self.folder):
            return make(self)

    return cached_property(run)


class Scenario:
    """The parts of an answer; each is a DataFrame. close() removes the tables they rest on."""

    def __init__(self, spark: SparkSession, query: str, parsed: DataFrame, errors: DataFrame, catalog: list[rules.Rule], links: DataFrame | None, schemas: list[graph.LinkSchema], authorised: set[tuple[str, int]] | None, places: DataFrame | None):
        self.spark, self.query, self.errors = spark, query, errors
        self._parsed, self._catalog, self._links, self._schemas, self._authorised, self._places = parsed, catalog, links, schemas, authorised, places
        self.folder = shared_dir(spark)

    def close(self) -> None:
        remove(self.spark, self.folder)

    def __enter__(self) -> Scenario:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @_part
    def _all(self) -> DataFrame:
        return materialize(self._parsed)

    @_part
    def edges(self) -> DataFrame | None:
        """Edges between nodes, with `ambiguous`; None where there is nothing to link by."""
        found = [e for e in (self._links, graph.declared(self._all, self._schemas) if self._schemas else None) if e is not None]
        if not found:
            return None
        return graph.with_ambiguity(materialize(found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)))

    def _allowed(self, ambiguous: bool = False) -> DataFrame:
        return self.edges.where("allows_correlation and " + ("ambiguous" if ambiguous else "not ambiguous"))

    @_part
    def _ways(self) -> DataFrame:
        return graph.both_ways(self._allowed())

    @_part
    def entries(self) -> DataFrame:
        """The selection: entries that hold the query or are linked to it, with identifiers, failures and reasons."""
        expansion = None
        if self.edges is not None:
            ids = search.exploded_identifiers(self._all)
            asked = ids.where(F.col("normalized") == normalize_query(self.query)).select(graph.node_of().alias("source")).distinct()
            expansion = search.expand(ids, self.query, graph.closure(self._allowed(), asked, ways=self._ways), self.edges)
        return materialize(search.selected(self._all, self.query, expansion))

    @_part
    def counts(self) -> DataFrame:
        known = self.entries if "category" in self.entries.columns else self.entries.withColumn("category", F.lit(rules.UNCLASSIFIED))
        return timeline.counts(known, "category", "app")

    @_part
    def timeline(self) -> DataFrame:
        dated, _ = timeline.timeline_parts(self.entries)
        return dated.withColumn("utc_text", utc_text(F.col("timestamp_utc"), F.col("precision")))

    @_part
    def undated(self) -> DataFrame:
        return timeline.timeline_parts(self.entries)[1]

    @_part
    def evidence(self) -> DataFrame:
        """Occurrences of identifiers that both applications have, without those of ambiguous links."""
        ambiguous = None
        if self.edges is not None:
            bad = self.edges.where("ambiguous")
            n = bad.select(F.col("src").alias("n")).union(bad.select("dst")).distinct()
            ambiguous = n.select(F.split("n", "\u0000")[0].alias("namespace"), F.split("n", "\u0000")[1].alias("normalized"))
        return materialize(correlate.shared_identifiers(search.exploded_identifiers(self.entries), ambiguous))

    def _chains(self, ambiguous: bool) -> tuple[DataFrame, DataFrame]:
        """(ends, steps) of the paths between the applications. They start from the channel's nodes of the selection."""
        own = search.exploded_identifiers(self.entries)
        sources = own.where("app = 'VPL'").select(graph.node_of().alias("source")).distinct()
        reach = graph.closure(self._allowed(ambiguous), sources, ways=None if ambiguous else self._ways)
        ends = materialize(correlate.chains(own, reach))
        return ends, graph.steps(reach, ends)

    @_part
    def _blocked(self) -> DataFrame | None:
        return self._chains(True)[0] if self.edges is not None else None

    @_part
    def _declared(self) -> DataFrame:
        """Allowed edges that selected entries declare, with these."""
        return materialize(self._allowed().join(self.entries.select("entry_id", "file_token", "read_order"), "entry_id"))

    @_part
    def traversed(self) -> DataFrame | None:
        """The steps of valid paths between the applications: source, node, at, a, b."""
        if self.edges is None:
            return None
        _, steps = self._chains(False)
        return materialize(steps.join(correlate.chains_of(steps, self._declared), ["source", "node"], "left_semi"))

    @_part
    def links(self) -> DataFrame | None:
        """Edges of valid paths with the entry that is their evidence, and the rule that found them."""
        if self.traversed is None:
            return None
        both = self.traversed.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(self.traversed.select("b", "a")).distinct()
        used = self._declared.join(both, ["src", "dst"], "left_semi")
        return used.withColumn("rule", F.format_string("vinculo:%s:v%d", "schema_id", "schema_version"))

    @_part
    def correlation(self) -> DataFrame:
        paths = self.traversed.select("source", "node").distinct() if self.traversed is not None else None
        return correlate.summary(self.entries, self.evidence, paths, self._blocked)

    @_part
    def _facts(self) -> DataFrame:
        return materialize(rules.scenario_facts(self.entries, self.edges))

    @_part
    def explanation(self) -> DataFrame:
        """What each condition of each rule rests on."""
        return materialize(rules.evidence(self._facts, rules.usable(self._catalog, self._authorised)))

    @_part
    def classification(self) -> DataFrame:
        """One row: category, rule_id, version, root_cause and what there is no more to say."""
        active = rules.usable(self._catalog, self._authorised)
        blocked = self._blocked is not None and not self._blocked.isEmpty()
        return rules.classify(rules.evaluate(self._facts, active), blocked, self.explanation)

    @_part
    def view(self) -> DataFrame:
        """All values of the answer, numbered and judged together: part, seq, type, safe, state."""
        return secure.secure_view(self._values())

    @property
    def secure(self) -> DataFrame:
        """The selected texts in their secure view: seq, safe, state."""
        return self.view.where("part = 'texts'").select("analysis_id", "seq", "safe", "state")

    @property
    def values(self) -> DataFrame:
        """Identifiers, fields, file references, links and evidence in their secure view."""
        return self.view.where("part <> 'texts'")

    def _values(self) -> DataFrame:
        none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
        number = F.coalesce(F.regexp_extract("file_token", r"(\d+)", 1).try_cast("long"), zero)
        kinds = {"chamada_externa": "CALL_ID", "uuid_canal": "UUID_CANAL", "uuid_sessao": "UUID_SESSAO"}
        kind = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("namespace")], F.lit("CALL_ID"))

        def row(df: DataFrame, part: str, of: Column, value: Column, at: Column = zero) -> DataFrame:
            seq = F.struct(number.alias("file"), F.col("read_order").cast("long").alias("entry"), at.cast("long").alias("at")).alias("seq")
            return df.select(F.lit(self.query).alias("analysis_id"), F.lit(part).alias("part"), seq, of.alias("type"), value.alias("value"))

        own = self.entries
        ids = own.select("file_token", "read_order", F.posexplode("identifiers").alias("n", "i")).select("file_token", "read_order", "n", "i.*")
        fields = own.select("file_token", "read_order", F.posexplode("fields").alias("n", "f"))
        asked = self.spark.range(1).select(none.alias("file_token"), zero.alias("read_order"))
        out = row(asked, "query", F.lit("CALL_ID"), F.lit(self.query))
        out = out.unionByName(row(ids, "identifiers", kind, F.col("original"), F.col("n")))
        out = out.unionByName(row(fields, "fields", placeholder_type(F.col("f.name")), F.col("f.value"), F.col("n")))
        out = out.unionByName(row(self.evidence, "evidence", kind, F.col("normalized")))
        out = out.unionByName(row(own, "texts", none, F.col("text")))
        if self._places is not None:
            out = out.unionByName(row(self._places.withColumn("read_order", zero), "files", F.lit("DADO_CLIENTE"), F.col("path")))
        if self.links is not None:
            ends = self.links.select("file_token", "read_order", F.posexplode(F.array("src", "dst")).alias("n", "end"))
            ends = ends.withColumns({"namespace": F.split("end", "\u0000")[0], "normalized": F.split("end", "\u0000")[1]})
            out = out.unionByName(row(ends, "links", kind, F.col("normalized"), F.col("n")))
        return out.where("value is not null")


def legacy_entries(spark: SparkSession, files: list[tuple[str, str]], query: str) -> tuple[DataFrame, DataFrame]:
    """The plain flow of line-based applications (VOCI): lines that hold the query, marked as correlated if
    every application asked for has some; and error rows for files and applications without."""
    sources, errors = logs.preflight(spark, files)
    known = sources.collect()  # at most one row for each of MAX_FILES files
    out = None
    for r in known:
        lines = headers.parse_voci(logs.text_lines(spark, r["path"])).withColumns({"app": F.lit(r["app"]), "file_token": F.lit(r["file_token"])})
        out = lines if out is None else out.unionByName(lines)
    if out is None:
        raise ValueError("NO_READABLE_FILE")
    kept = search.contains_text(out, "text", query).withColumn("read_order", F.col("line_no") - 1).withColumn("timestamp", F.try_to_timestamp("timestamp_original"))
    marked, missing = correlate.presence(kept, sorted({a for a, _ in files}))
    failed = errors.select(F.col("file_token").alias("of"), F.col("code").alias("description"))
    return timeline.legacy_timeline(marked), failed.unionByName(missing.select(F.col("app").alias("of"), "description"))


def _rows(title: str, lines: list[str]) -> list[str]:
    return ["", title, *(lines or ["  none"])]


def report(scenario: Scenario) -> str:
    """A text report of a scenario: all its parts, values and texts from the secure view alone. All lines are made
    before any is shown, and the scanner looks at them once more; an error of any part leaves no half of a report."""
    c = scenario.correlation.first()
    k = scenario.classification.first()
    lines = [f"correlation: {'found' if c['found'] else 'not found'} ({c['base']})" + (f": {c['reason']}" if c["reason"] else ""), f"category: {k['category']}", f"rule: {k['rule_id'] or 'none'}{' v' + str(k['version']) if k['rule_id'] else ''}", f"root cause: {k['root_cause'] or 'undetermined'}"]
    lines += [f"note: {m}" for m in k["messages"]]
    lines += ["", *(f"{r['dimension']} {r['key']}: {r['n']}" for r in scenario.counts.orderBy("dimension", "key").toLocalIterator())]
    lines += _rows("errors:", [f"  {r['file_token']} [{r['app']}] {r['code']}" for r in scenario.errors.orderBy("file_token").toLocalIterator()])
    shown = F.col("safe").isNotNull() & (F.trim("safe") != "")
    for part in ("query", "identifiers", "fields", "files", "links", "evidence"):
        values = scenario.values.where((F.col("part") == part) & F.col("type").isNotNull() & shown).groupBy("type", "safe").count().orderBy("type", "safe")
        lines += _rows(f"{part}:", [f"  {r['type']} {r['safe']} ({r['count']})" for r in values.toLocalIterator()])
    told = scenario.explanation.where(F.col("rule_id") == F.lit(k["rule_id"])).orderBy("condition_id")
    lines += _rows("conditions:", [f"  {r['condition_id']} ({r['n_evidence']})" for r in told.toLocalIterator()])
    if scenario.links is not None:
        used = scenario.links.select("rule", "entry_id").distinct().orderBy("rule", "entry_id")
        lines += _rows("links by:", [f"  {r['rule']} {r['entry_id']}" for r in used.toLocalIterator()])
    lines += _rows("timeline:", [f"{r['utc_text']} {r['app']} {r['entry_id']}" for r in scenario.timeline.select("utc_text", "app", "entry_id").toLocalIterator()])
    lines += _rows("without UTC:", [f"{r['app']} {r['entry_id']}" for r in scenario.undated.select("app", "entry_id").toLocalIterator()])
    lines += _rows("texts:", [(r["safe"] or "suppressed").rstrip("\n") for r in scenario.secure.orderBy("seq").toLocalIterator()])
    left = scenario.spark.createDataFrame([(line,) for line in lines], "line string").where(scanner.findings(F.col("line")) > 0)
    if not left.isEmpty():
        raise ValueError(UNSAFE)
    return "\n".join(lines) + "\n"


def legacy_report(query: str, entries: DataFrame, errors: DataFrame) -> str:
    """The plain report of line-based applications: each application's entries, counts by category and by
    application, then errors."""
    lines = [f"analysis of: {query}", ""]
    n = {r["app"]: r["n"] for r in entries.groupBy("app").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each application
    if not n:
        return "\n".join([*lines, "no entry holds the identifier", *(f"  {r['of']}: {r['description']}" for r in errors.toLocalIterator())]) + "\n"
    app = None
    for r in entries.orderBy("app", "file_token", "read_order").toLocalIterator():
        if r["app"] != app:
            app = r["app"]
            lines += [f"[{app}] ({n[app]} entries)"]
        lines.append(f"  {r['timestamp_original'] or 'no time'} {r['level'] or '-'} {r['message'] or r['text']}")
    lines += ["", *(f"app {a}: {n[a]}" for a in sorted(n))]
    return "\n".join(lines + _rows("errors:", [f"  {r['of']}: {r['description']}" for r in errors.toLocalIterator()])) + "\n"
