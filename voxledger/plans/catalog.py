"""The registered queries of the log-analytics operators on the driver tables, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.functions.identifiers import normalized_sql
from voxledger.functions.prefix import last_so_far, running_sum
from voxledger.functions.store import shared_dir
from voxledger.operators import correlate, governance, graph, rules, sanitize, scanner, search, secure, stats, summaries, timeline
from voxledger.sources import logs, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "scenario_counts"


def query(oracle: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its DuckDB form if SQL has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path (the doc_id), line_no from 1, text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "text")


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents"


@query("SELECT CAST(count(*) AS BIGINT) AS n, kind, key FROM (SELECT 'category' AS kind, event_type AS key FROM events UNION ALL SELECT 'app', CAST(user_id % 7 AS VARCHAR) FROM events) GROUP BY kind, key")
def scenario_counts(spark, sf_dir):
    """Counts by category and by application in one pass."""
    e = table(spark, sf_dir, "events").withColumn("app", F.col("user_id") % 7)
    return timeline.counts(e, "event_type", "app").select(F.col("dimension").alias("kind"), "key", "n")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license')")
def literal_filter(spark, sf_dir):
    """Rows whose text holds a word, whatever its case."""
    return search.contains_text(table(spark, sf_dir, "documents"), "text", "LICENSE").select("doc_id", "lang")


@query("""SELECT event_id, part, CAST(row_number() OVER (PARTITION BY part ORDER BY t NULLS LAST, event_type, event_id) AS BIGINT) AS position
FROM (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE epoch_us(ts) END AS t, CASE WHEN event_type = 'error' THEN 'undated' ELSE 'dated' END AS part FROM events)""")
def timeline_partition(spark, sf_dir):
    """Dated and undated entries, each numbered in its own order."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_type") != "error", micros("ts")).alias("t"))
    parted = e.withColumns({"part": F.when(F.col("t").isNull(), "undated").otherwise("dated"), "one": F.lit(1).cast("long"), "b": F.coalesce(F.floor(F.col("t") / 3_600_000_000), F.lit(0)), "c": F.when(F.col("t").isNull(), F.col("event_type")).otherwise("")})
    return running_sum(parted, ["part"], ["b", "c"], [F.col("t").asc_nulls_last(), F.col("event_type"), F.col("event_id")], "one", "position").select("event_id", "part", "position")


@query("""WITH d AS (SELECT user_id, (epoch_us(arg_max(ts, event_id)) - epoch_us(arg_min(ts, event_id))) / 1e6 AS s FROM events GROUP BY user_id)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(s), 3) AS mean, list_sort(list(s))[CAST(floor(count(*) * 0.5) AS INTEGER) + 1] AS upper_median, max(s) AS max, min(s) AS min,
CAST(count(*) FILTER (WHERE s > 60) AS BIGINT) AS over_60, CAST(count(*) FILTER (WHERE s > 120) AS BIGINT) AS over_120, CAST(count(*) FILTER (WHERE s < 10) AS BIGINT) AS under_10 FROM d WHERE s > 0""")
def first_last_duration(spark, sf_dir):
    """Statistics of the time from each user's first to last event in event order."""
    s = stats.durations(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return stats.duration_stats(s).withColumn("mean", F.round("mean", 3))


@query("""SELECT CAST(count(v) AS BIGINT) AS n, round(avg(v), 6) AS mean, max(v) AS max, min(v) AS min, CAST(count(*) FILTER (WHERE v > 100) AS BIGINT) AS over_100,
CAST(count(*) FILTER (WHERE v > 500) AS BIGINT) AS over_500, list_sort(list(v))[CAST(floor(count(v) * 0.95) AS INTEGER) + 1] AS p95 FROM (SELECT value AS v FROM events WHERE value IS NOT NULL)""")
def index_percentiles(spark, sf_dir):
    """Latency statistics with the index percentile."""
    return stats.latency_stats(table(spark, sf_dir, "events"), "value").withColumn("mean", F.round("mean", 6))


@query("""SELECT l_quantity AS value FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) - 1 AS i, count(*) OVER () AS n FROM lineitem WHERE l_quantity IS NOT NULL)
WHERE i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))""")
def ranked_value(spark, sf_dir):
    """The value at an index of the sorted column, from counts in order."""
    return stats.ranked_value(table(spark, sf_dir, "lineitem"), "l_quantity", 0.95)


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id ORDER BY count(*) DESC, min(event_id), user_id LIMIT 10")
def top_counters(spark, sf_dir):
    """The ten most frequent users; of equal counts the one seen first."""
    return stats.top(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 ORDER BY count(*) DESC, min(o_orderkey), 1 LIMIT 10")
def top_priorities(spark, sf_dir):
    """The most frequent order priorities."""
    return stats.top(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


@query("""SELECT CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS misses,
round(100.0 * count(*) FILTER (WHERE event_type = 'click') / count(*) FILTER (WHERE event_type IN ('click', 'view')), 6) AS hit_rate FROM events""")
def hit_rate(spark, sf_dir):
    """Hits, misses and their rate."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", "HIT").when(F.col("event_type") == "view", "MISS").alias("cache"))
    return stats.hit_rate(e).withColumn("hit_rate", F.round("hit_rate", 6))


@query("SELECT CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT user_id) AS BIGINT) AS calls, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS no_voice_timeouts FROM events")
def totals(spark, sf_dir):
    """Lines, calls and time-outs."""
    return stats.totals(table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), (F.col("event_type") == "error").alias("no_voice")))


@query("SELECT user_id AS call_id, n FROM (SELECT user_id, CAST(count(*) AS BIGINT) AS n, min(event_id) AS f FROM events GROUP BY user_id ORDER BY n DESC, f, user_id LIMIT 20) ORDER BY (n > 200) DESC, n DESC, f LIMIT 1")
def busy_call(spark, sf_dir):
    """The busiest call."""
    return stats.busy_call(table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("line_no")))


@query("SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stage FROM events")
def stage_carry_forward(spark, sf_dir):
    """The stage in effect at each event."""
    e = table(spark, sf_dir, "events").withColumn("s", F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")))
    return timeline.carried_forward(e, "s", "user_id", ["event_id"], "stage").select("event_id", "stage")


@query("SELECT f AS from_role, role AS to_role, CAST(count(*) AS BIGINT) AS n FROM (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM conversations) WHERE f IS NOT NULL GROUP BY 1, 2")
def stage_transitions(spark, sf_dir):
    """How often each role follows which."""
    c = table(spark, sf_dir, "conversations")
    return stats.transitions(c, "conv_id", "turn", "role").withColumnsRenamed({"from_value": "from_role", "to_value": "to_role"})


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars, string_agg(role, '>' ORDER BY turn) AS roles,
max(turn) FILTER (WHERE role = 'assistant') AS last_assistant_turn FROM conversations GROUP BY conv_id""")
def conversation_rollup(spark, sf_dir):
    """One row for each conversation: turns in order."""
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("n_chars"), roles.alias("roles"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_assistant_turn"))


@query(f"""WITH l AS (SELECT *, CASE WHEN length(text) > 0 AND ascii(text) BETWEEN 65 AND 77 THEN 1 ELSE 0 END AS s FROM ({_LINES})),
g AS (SELECT *, sum(s) OVER w AS g FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, CASE WHEN g = 0 THEN line_no - 1 ELSE count(*) FILTER (WHERE g = 0) OVER (PARTITION BY doc_id) + g - 1 END AS read_order FROM g)
SELECT doc_id, CAST(read_order AS BIGINT) AS read_order, CAST(min(line_no) AS BIGINT) AS line_start, CAST(max(line_no) AS BIGINT) AS line_end, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM o GROUP BY doc_id, read_order""")
def multiline_blocks(spark, sf_dir):
    """Lines grouped into blocks: a line that starts with A to M opens one; lines before the first are orphans."""
    from voxledger.operators.blocks import blocks

    l = document_lines(spark, sf_dir)
    code = F.ascii("text")
    kind = F.when((F.length("text") > 0) & code.between(65, 77), "CABECALHO_VALIDO").otherwise("CONTINUACAO")
    ready = l.select(F.col("doc_id").cast("string").alias("file_token"), F.lit("DOC").alias("app"), "line_no", F.lit(0).cast("long").alias("start_byte"), F.lit(0).cast("long").alias("end_byte"), "text", F.lit("").alias("terminator"), kind.alias("start_kind"))
    return blocks(ready).select(F.col("file_token").cast("long").alias("doc_id"), "read_order", "line_start", "line_end", F.length("text").cast("long").alias("n_chars"))


@query(f"""SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(e - n AS BIGINT) AS start_byte, CAST(e - 1 AS BIGINT) AS end_byte, sha256(text) AS digest FROM
(SELECT *, strlen(text) + 1 AS n, sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS e FROM ({_LINES}))""")
def physical_lines(spark, sf_dir):
    """Documents written as log files, a marked line before each, and read again by the byte-exact reader: byte ranges and
    digests of the lines of each document."""
    own = _lines_of_files(spark, sf_dir)
    place = lambda c: F.col(c) - F.col("of.end_byte")
    body = F.octet_length("terminator")
    return own.select(
        "of.doc_id", (F.col("line_no") - F.col("of.line_no")).alias("line_no"), place("start_byte").alias("start_byte"), (place("end_byte") - F.least(body, F.lit(1))).alias("end_byte"),
        F.sha2(F.concat("text", F.when(body == 2, "\r").otherwise("")), 256).alias("digest"),
    )


def _lines_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    table(spark, sf_dir, "documents").select(F.concat(F.lit("\u0001"), F.col("doc_id").cast("string"), F.lit("\n"), "text")).write.text(folder)
    lines = logs.physical_lines(spark, folder).withColumn("bucket", F.floor(F.col("line_no") / 100_000))
    mark = F.when(F.startswith("text", F.lit("\u0001")), F.struct(F.substring("text", 2, 20).cast("long").alias("doc_id"), "line_no", "end_byte"))
    return last_so_far(lines, ["path"], ["bucket"], ["line_no"], mark, "of").where(~F.startswith("text", F.lit("\u0001")))


@query(f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, sha256(text || chr(10)) AS digest, CAST(NULL AS VARCHAR) AS code FROM ({_LINES})")
def reread_lines(spark, sf_dir):
    """Every line of documents written as files, read a second time by its range of bytes and checked."""
    lines = _lines_of_files(spark, sf_dir)
    named = lines.withColumn("entry_id", F.concat_ws(":", "of.doc_id", F.col("line_no") - F.col("of.line_no")))
    again, of = logs.reread(named), F.split("entry_id", ":")
    return again.select(of[0].cast("long").alias("doc_id"), of[1].cast("long").alias("line_no"), F.sha2("text", 256).alias("digest"), "code")


@query("""SELECT event_id, regexp_extract(props, '"([a-z]+)":', 1) AS key, regexp_extract(props, ':\\s*(\\d+)', 1) AS value FROM events""")
def key_value_extract(spark, sf_dir):
    """Keys and values by pattern."""
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", '"([a-z]+)":', 1).alias("key"), F.regexp_extract("props", r":\s*(\d+)", 1).alias("value"))


@query("SELECT k, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY k")
def json_extract(spark, sf_dir):
    """Values out of JSON documents, and how often each occurs."""
    return table(spark, sf_dir, "events").select(F.from_json("props", "k bigint")["k"].alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT side, n_nationkey, CAST(count(*) AS BIGINT) AS n FROM (
SELECT 'left' AS side, c_nationkey AS n_nationkey FROM customer WHERE c_acctbal < 0 AND c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)
UNION ALL SELECT 'right', s_nationkey FROM supplier WHERE s_acctbal > 0 AND s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)) GROUP BY 1, 2""")
def shared_value_join(spark, sf_dir):
    """Evidence on both sides of a shared key."""
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("n_nationkey"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return correlate.shared_values(c, s, ["n_nationkey"]).groupBy("side", "n_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT doc_id FROM documents WHERE source = 'src3')
SELECT doc_id, 'structured' AS reason FROM s UNION ALL SELECT doc_id, 'literal' FROM documents WHERE contains(lower(text), 'license') AND doc_id NOT IN (SELECT doc_id FROM s)""")
def literal_fallback(spark, sf_dir):
    """Literal matches only where there is no structured one."""
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "entry_id")
    s = d.where("source = 'src3'").select("entry_id")
    found = s.withColumn("reason", F.lit("structured")).unionByName(search.literal(d, "LICENSE", s).withColumn("reason", F.lit("literal")))
    return found.withColumnRenamed("entry_id", "doc_id")


@query("""SELECT n_nationkey, CAST(count(DISTINCT app) AS BIGINT) AS apps, count(DISTINCT app) = 2 AS correlated FROM (SELECT c_nationkey AS n_nationkey, 'c' AS app FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier) GROUP BY 1""")
def presence_by_group(spark, sf_dir):
    """Which groups have entries of both applications."""
    both = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.lit("c").alias("app")).union(table(spark, sf_dir, "supplier").select("s_nationkey", F.lit("s")))
    return correlate.presence_by(both, ["n_nationkey"], 2)


@query("SELECT app, CAST(count(*) AS BIGINT) AS n, true AS correlated FROM (SELECT event_type AS app FROM events WHERE event_type IN ('click', 'view')) GROUP BY 1")
def presence_correlation(spark, sf_dir):
    """All entries are correlated because both applications have some."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'view')").withColumnRenamed("event_type", "app")
    return correlate.presence(e, ["click", "view"])[0].groupBy("app", "correlated").agg(F.count(F.lit(1)).alias("n"))


_EDGES = "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    return n.union(c)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
w AS (SELECT 'r0' AS node, 0 AS depth UNION SELECT b.dst, w.depth + 1 FROM w JOIN b ON b.src = w.node WHERE w.depth < 6)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY node""")
def link_closure(spark, sf_dir):
    """Everything linked to one node, with the length of a shortest path."""
    seeds = spark.range(1).select(F.lit("r0").alias("source"))
    return graph.closure(_edges(spark, sf_dir), seeds).select("node", F.col("depth").cast("long").alias("depth"))


@query("""WITH m AS (SELECT 'r' || n_regionkey AS region, 'n' || n_nationkey AS node FROM nation UNION SELECT 'r' || n_regionkey, 'r' || n_regionkey FROM nation
UNION SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT node, min(node) OVER (PARTITION BY region) AS component FROM m""")
def link_components(spark, sf_dir):
    """The connected component of every node."""
    return graph.components(_edges(spark, sf_dir))


@query(f"""WITH e AS ({_EDGES}) SELECT dst AS node, CAST(count(DISTINCT src) AS BIGINT) AS partners FROM e GROUP BY dst HAVING count(DISTINCT src) > 1""")
def cardinality_violation(spark, sf_dir):
    """Targets with several sources where each may have one."""
    e = _edges(spark, sf_dir).withColumns({"schema_id": F.lit("s"), "schema_version": F.lit(1), "cardinality": F.lit("1:1")})
    return graph.cardinality_violations(e).select("node", "partners")


_FACTS = """SELECT event_type AS app, 'E' || event_id AS entry_id, ts FROM events"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    entries = e.select(F.col("event_type").alias("app"), F.concat(F.lit("E"), "event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("timestamp_utc"), F.array(F.struct(F.lit("value").alias("name"), F.col("value").cast("string").alias("value"))).alias("fields"))
    return rules.scenario_facts(entries)


def _rule(rule_id: str, precedence: int, *conditions: dict) -> rules.Rule:
    return rules.Rule(rule_id, 1, "CAT_" + rule_id, ("view",), tuple({"condition_id": f"c{i}", **c} for i, c in enumerate(conditions)), precedence)


RULES = [
    _rule("many_views", 30, {"operator": "CARDINALITY", "target": "ENTRY", "comparison": "GTE", "value": 50, "application": "view"}),
    _rule("few_views", 10, {"operator": "CARDINALITY", "target": "ENTRY", "comparison": "LT", "value": 5, "application": "view"}),
    _rule("ordered", 20, {"operator": "TEMPORAL_ORDER", "before": {"entry_id": "E1"}, "after": {"entry_id": "E990"}}),
    _rule("both", 25, {"operator": "APPLICATION_PRESENT", "application": "click"}, {"operator": "FIELD_PRESENT", "field": "value"}),
    _rule("broken", 5, {"operator": "NO_SUCH"}),
]


@query(f"""WITH e AS ({_FACTS}) SELECT * FROM (
SELECT 'many_views' AS rule_id, CASE WHEN count(*) FILTER (WHERE app = 'view') >= 50 THEN 'SATISFEITA' ELSE 'NAO_SATISFEITA' END AS state FROM e
UNION ALL SELECT 'few_views', CASE WHEN count(*) FILTER (WHERE app = 'view') < 5 THEN 'SATISFEITA' ELSE 'NAO_SATISFEITA' END FROM e
UNION ALL SELECT 'ordered', CASE WHEN max(ts) FILTER (WHERE entry_id = 'E1') < min(ts) FILTER (WHERE entry_id = 'E990') THEN 'SATISFEITA' ELSE 'NAO_SATISFEITA' END FROM e
UNION ALL SELECT 'both', CASE WHEN count(*) FILTER (WHERE app = 'click') > 0 THEN 'SATISFEITA' ELSE 'NAO_SATISFEITA' END FROM e
UNION ALL SELECT 'broken', 'ERRO_SEGURO')""")
def rule_conditions(spark, sf_dir):
    """Each rule's state over the facts of a scenario."""
    return rules.evaluate(_facts(spark, sf_dir), RULES).select("rule_id", "state")


@query(f"""WITH e AS ({_FACTS}), r AS (SELECT 20 AS p, 'ordered' AS id WHERE (SELECT max(ts) FILTER (WHERE entry_id = 'E1') < min(ts) FILTER (WHERE entry_id = 'E990') FROM e)
UNION ALL SELECT 25, 'both' UNION ALL SELECT 30, 'many_views' WHERE (SELECT count(*) FILTER (WHERE app = 'view') >= 50 FROM e))
SELECT 'CAT_' || arg_min(id, p) AS category, arg_min(id, p) AS rule_id FROM r""")
def rule_precedence(spark, sf_dir):
    """The satisfied rule of least precedence classifies; a broken rule would have stopped that."""
    return rules.classify(rules.evaluate(_facts(spark, sf_dir), [r for r in RULES if r.rule_id != "broken"])).select("category", "rule_id")


@query(f"""WITH e AS ({_FACTS}), r AS (SELECT 20 AS p, 'CAT_ordered' AS c WHERE (SELECT max(ts) FILTER (WHERE entry_id = 'E1') < min(ts) FILTER (WHERE entry_id = 'E990') FROM e) UNION ALL SELECT 25, 'CAT_both')
SELECT 'sound' AS rules, arg_min(c, p) AS category FROM r UNION ALL SELECT 'with a broken one', 'NAO_CLASSIFICADA' UNION ALL SELECT 'ambiguous links', 'NAO_CLASSIFICADA'""")
def rule_fail_closed(spark, sf_dir):
    """One rule that can't be evaluated, or ambiguous links, leave everything unclassified."""
    facts, sound = _facts(spark, sf_dir), [r for r in RULES if r.rule_id != "broken"]
    runs = {"sound": (sound, False), "with a broken one": (RULES, False), "ambiguous links": (sound, True)}
    out = [rules.classify(rules.evaluate(facts, own), unsafe).select(F.lit(name).alias("rules"), "category") for name, (own, unsafe) in runs.items()]
    return out[0].union(out[1]).union(out[2])


@query(f"""WITH e AS ({_FACTS}) SELECT 'ordered' AS rule_id, 'c0' AS condition_id, CAST(2 AS BIGINT) AS n_evidence, 'entry:E1' AS ref FROM e WHERE entry_id = 'E1'
UNION ALL SELECT 'many_views', 'c0', count(*), min('entry:' || entry_id) FROM e WHERE app = 'view' UNION ALL SELECT 'few_views', 'c0', count(*), min('entry:' || entry_id) FROM e WHERE app = 'view'
UNION ALL SELECT 'both', 'c0', 1, 'application:click' UNION ALL SELECT 'both', 'c1', count(*), min('field:' || entry_id || ':0') FROM e""")
def rule_evidence(spark, sf_dir):
    """How many facts each condition of each rule rests on, and the least of them."""
    return rules.evidence(_facts(spark, sf_dir), RULES).select("rule_id", "condition_id", "n_evidence", "ref")


_MIXED = [{"operator": "APPLICATION_PRESENT", "application": "view"}, {"operator": "CARDINALITY", "target": "FACT", "comparison": "LT", "value": 5}]


@query("""SELECT * FROM (VALUES ('no evidence first', 'NAO_CLASSIFICADA', 'NENHUMA_REGRA_VALIDADA_CORRESPONDEU'), ('one condition without', 'NAO_CLASSIFICADA', 'NENHUMA_REGRA_VALIDADA_CORRESPONDEU'), ('all with', 'CAT_second', 'CAUSA_RAIZ_NAO_DETERMINADA')) AS t(rules, category, message),
(SELECT count(*) AS n FROM events WHERE event_type = 'view') WHERE n > 0""")
def rule_support(spark, sf_dir):
    """A winner one of whose conditions no fact supports leaves all unclassified: the next rule doesn't take its place."""
    facts, second = _facts(spark, sf_dir), _rule("second", 2, {"operator": "APPLICATION_PRESENT", "application": "view"})
    runs = {"no evidence first": [_rule("first", 1, _MIXED[1]), second], "one condition without": [_rule("first", 1, *_MIXED), second], "all with": [second]}
    out = None
    for name, own in runs.items():
        k = rules.classify(rules.evaluate(facts, own), False, rules.evidence(facts, own)).select(F.lit(name).alias("rules"), "category", F.col("messages")[0].alias("message"))
        out = k if out is None else out.unionByName(k)
    return out.withColumn("n", F.lit(table(spark, sf_dir, "events").where("event_type = 'view'").count()).cast("long"))


CALL_RULES = [
    rules.Rule("failed", 1, "ERRO", ("error",), ({"condition_id": "often", "operator": "CARDINALITY", "target": "ENTRY", "comparison": "GTE", "value": 3, "application": "error"},), 10, root_cause="REPEATED_ERRORS"),
    rules.Rule("quiet", 2, "SUCESSO", ("signup",), ({"condition_id": "none", "operator": "CARDINALITY", "target": "ENTRY", "comparison": "EXACTLY", "value": 0, "application": "error"},), 15),
    rules.Rule("sold", 1, "SUCESSO", ("view", "purchase"), ({"condition_id": "both", "operator": "FIELD_PRESENT", "field": "value", "application": "purchase"}, {"condition_id": "order", "operator": "TEMPORAL_ORDER", "before": {"application": "view"}, "after": {"application": "purchase"}, "allow_equal": True}), 20),
]


@query("""WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'signup') AS signups, count(*) FILTER (WHERE event_type = 'purchase') AS sales, count(*) FILTER (WHERE event_type = 'view') AS views,
max(ts) FILTER (WHERE event_type = 'view') <= min(ts) FILTER (WHERE event_type = 'purchase') AS ordered, min('entry:E' || event_id) FILTER (WHERE event_type = 'error') AS e_ref, min('field:E' || event_id || ':0') FILTER (WHERE event_type = 'purchase') AS s_ref FROM events GROUP BY user_id),
k AS (SELECT *, CASE WHEN errors >= 3 THEN 'failed' WHEN errors = 0 AND signups > 0 THEN NULL WHEN views > 0 AND sales > 0 AND ordered THEN 'sold' END AS rule_id FROM c)
SELECT user_id, CASE rule_id WHEN 'failed' THEN 'ERRO' WHEN 'sold' THEN 'SUCESSO' ELSE 'NAO_CLASSIFICADA' END AS category, rule_id, CASE rule_id WHEN 'failed' THEN 'REPEATED_ERRORS' END AS root_cause,
CASE WHEN rule_id IS NULL THEN 'NENHUMA_REGRA_VALIDADA_CORRESPONDEU,CAUSA_RAIZ_NAO_DETERMINADA' WHEN rule_id = 'sold' THEN 'CAUSA_RAIZ_NAO_DETERMINADA' ELSE '' END AS messages,
CASE rule_id WHEN 'failed' THEN 'often=' || errors || ':' || e_ref WHEN 'sold' THEN 'both=' || sales || ':' || s_ref ELSE '' END AS first_evidence FROM k""")
def classified_calls(spark, sf_dir):
    """All calls classified at once: rules by precedence, evidence by condition, what there is no more to say. A call
    without errors but with a signup has a winner that rests on nothing, so it stays unclassified."""
    e = table(spark, sf_dir, "events")
    entries = e.select("user_id", F.col("event_type").alias("app"), F.concat(F.lit("E"), "event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("timestamp_utc"), F.array(F.struct(F.lit("value").alias("name"), F.col("value").cast("string").alias("value"))).alias("fields"))
    by = ("user_id",)
    facts = rules.scenario_facts(entries, by=by)
    found = rules.evidence(facts, CALL_RULES, by)
    classified = rules.classify(rules.evaluate(facts, CALL_RULES, by), False, found, by)
    first = found.groupBy("user_id", "rule_id").agg(F.min(F.format_string("%s=%d:%s", "condition_id", "n_evidence", "ref")).alias("first_evidence"))
    out = classified.join(first, ["user_id", "rule_id"], "left")
    return out.select("user_id", "category", "rule_id", "root_cause", F.array_join("messages", ",").alias("messages"), F.coalesce("first_evidence", F.lit("")).alias("first_evidence"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_association_wins(spark, sf_dir):
    """The last row of each key."""
    return timeline.last_association(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT user_id, CAST(min(event_id) AS BIGINT) AS first_at FROM events GROUP BY user_id")
def ordered_distinct(spark, sf_dir):
    """Distinct keys by first occurrence."""
    return timeline.ordered_distinct(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS created_at, max(event_id) AS modified_at FROM events GROUP BY user_id")
def report_upsert(spark, sf_dir):
    """The current value of each key of an append-only log."""
    return reports.current(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""SELECT coalesce(a.h, b.h) AS digest, CASE WHEN a.h IS NULL THEN 'missing' WHEN b.h IS NULL THEN 'extra' ELSE 'both' END AS state, CAST(coalesce(a.n, 0) AS BIGINT) AS n
FROM (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT DISTINCT sha256(text) AS h FROM benchmark) b ON a.h = b.h""")
def full_outer_digest(spark, sf_dir):
    """Declared against real artefacts by digest."""
    a = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("digest"), F.col("item_id").cast("string").alias("item")).dropDuplicates(["digest"])
    found = governance.compared(b.select("digest", F.lit(None).cast("string").alias("declared")), a.select("digest", "n", F.lit(None).cast("string").alias("real")), "digest")
    state = F.when(F.col("state") == "undeclared", "extra").when(F.col("state") == "missing", "missing").otherwise("both")
    return found.select("digest", state.alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT op, k FROM (SELECT 'intersect' AS op, k FROM (SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT DISTINCT s_nationkey FROM supplier)
UNION ALL SELECT 'except', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'union', k FROM (SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region))""")
def set_ops(spark, sf_dir):
    """Intersection, difference and union of keys."""
    n, s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    c, r = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    parts = [("intersect", c.intersect(s)), ("except", n.subtract(s)), ("union", n.union(r).distinct())]
    out = [p.select(F.lit(name).alias("op"), "k") for name, p in parts]
    return out[0].union(out[1]).union(out[2])


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9.!#$%&*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS BIGINT) AS emails,
CAST(len(regexp_extract_all(text, '(?:[0-9]{1,3}\.){3}[0-9]{1,3}')) AS BIGINT) AS quads FROM documents""")
def pii_counts(spark, sf_dir):
    """How many e-mail addresses and dotted quads each document has, by plain patterns."""
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n(r"[A-Za-z0-9.!#$%&*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").alias("emails"), n(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}").alias("quads"))


@query(None)
def pii_detect(spark, sf_dir):
    """Sensitive spans of every document by type: all detectors. Spans that overlap in part count as one."""
    d = table(spark, sf_dir, "documents").select("doc_id", sanitize.all_spans(F.col("text")).alias("d"))
    return d.select("doc_id", F.explode("d").alias("s")).groupBy("doc_id", "s.type").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9-]+\.[a-z]+')) AS v, generate_subscripts(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9-]+\.[a-z]+'), 1) AS i FROM documents),
f AS (SELECT v, min(doc_id * 100000 + i) AS first FROM x GROUP BY v) SELECT v AS value, '<DADO_CLIENTE_' || row_number() OVER (ORDER BY first) || '>' AS placeholder FROM f""")
def placeholder_index(spark, sf_dir):
    """Placeholders numbered by the first occurrence of their values."""
    d = table(spark, sf_dir, "documents").select(F.lit("all").alias("analysis_id"), F.col("doc_id").alias("seq"), F.regexp_extract_all("text", F.lit(r"[a-z0-9.]+@[a-z0-9-]+\.[a-z]+"), F.lit(0)).alias("v"))
    spans = F.transform("v", lambda x, i: F.struct(F.lit("DADO_CLIENTE").alias("type"), i.alias("span_start"), i.alias("span_end"), x.alias("normalized")))
    return secure.placeholders(d.select("analysis_id", F.lit(1).alias("rank"), "seq", F.struct(spans.alias("spans")).alias("d"))).select(F.col("normalized").alias("value"), "placeholder")


@query(r"""SELECT page_id, h AS host, regexp_matches(h, '^localhost$|\.(?:corp|internal|intranet|invalid|lan|local|private|test|home\.arpa)$|^[^.]*$|^(?:10|127|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\.[0-9.]+$') AS internal
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) || CASE page_id % 4 WHEN 0 THEN '.local' ELSE '' END AS h FROM pages)""")
def internal_url(spark, sf_dir):
    """Hosts of pages, a fourth of them moved to an inner domain, and whether they are internal."""
    host = F.concat(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1), F.when(F.col("page_id") % 4 == 0, ".local").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), scanner.internal_host(host).alias("internal"))


@query("""SELECT conv_id, turn, CASE WHEN v LIKE '(%)' THEN lower(trim(substr(v, 2, length(v) - 2))) ELSE lower(v) END AS normalized FROM
(SELECT conv_id, turn, trim(CASE WHEN turn % 2 = 0 THEN ' (' || role || ') ' ELSE role END) AS v FROM conversations)""")
def identifier_normalize(spark, sf_dir):
    """Identifiers without their outer marks, in lower case."""
    c = table(spark, sf_dir, "conversations").withColumn("v", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" ("), "role", F.lit(") "))).otherwise(F.col("role")))
    return c.select("conv_id", "turn", normalized_sql(F.col("v")).alias("normalized"))


@query("""SELECT user_id, arg_max(event_type, (CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE -1 END) * 10000000 - event_id) AS failure FROM events GROUP BY user_id""")
def failure_priority(spark, sf_dir):
    """The most telling failure of each group; of equal ones the first."""
    return summaries.main_failure(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", ("view", "click", "error"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def representative_occurrence(spark, sf_dir):
    """One occurrence for each node."""
    return summaries.representative(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def missing_applications(spark, sf_dir):
    """Keys asked for that nothing has."""
    have = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    return summaries.missing(have, table(spark, sf_dir, "nation"), "n_nationkey")


@query("""SELECT o_orderkey, o_custkey, l_quantity FROM orders LEFT JOIN (SELECT l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS r FROM lineitem) WHERE r = 1) ON o_orderkey = l_orderkey""")
def evidence_lookup(spark, sf_dir):
    """References with the first entry each points to."""
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    found = summaries.first_match(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), entries, ["o_orderkey"], ["l_linenumber", "l_quantity"])
    return found.select("o_orderkey", "o_custkey", F.col("entry.l_quantity").alias("l_quantity"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 3 AND l_orderkey % 5 <> 0 THEN o_orderstatus END AS app FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def evidence_location(spark, sf_dir):
    """References with the application of the entry that holds their lines: entries of three lines, some of them
    claimed by a second application."""
    o = table(spark, sf_dir, "orders")
    entry = lambda df, app: df.select(F.lit("f").alias("file_token"), F.col("o_orderkey").alias("entry_id"), app.alias("app"), F.lit(1).alias("line_start"), F.lit(3).alias("line_end"))
    entries = entry(o, F.col("o_orderstatus")).union(entry(o.where("o_orderkey % 5 = 0"), F.lit("other")))
    place = {"file_token": F.lit("f"), "entry_id": F.col("l_orderkey"), "line_start": F.col("l_linenumber"), "line_end": F.col("l_linenumber")}
    return summaries.located(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").withColumns(place), entries).select("l_orderkey", "l_linenumber", "app")


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def json_rows(spark, sf_dir):
    """Rows as JSON in field order."""
    return summaries.json_rows(table(spark, sf_dir, "region"))


@query("""SELECT l.doc_id, l.quality, d.lang, d.n_chars FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.lang = 'en'""")
def report_enrichment(spark, sf_dir):
    """Reports with what else is known about them, where something is."""
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "lang", "n_chars")
    return reports.enriched(table(spark, sf_dir, "labels").select("doc_id", "quality"), d, "doc_id")


@query("""SELECT conv_id, turn, CASE WHEN role LIKE '%user%' THEN 'DADO_CLIENTE' END AS kind FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user_name' ELSE role END AS role FROM conversations)""")
def placeholder_type(spark, sf_dir):
    """The kind of value a field's name announces."""
    c = table(spark, sf_dir, "conversations").withColumn("f", F.when(F.col("role") == "user", "user_name").otherwise(F.col("role")))
    return c.select("conv_id", "turn", summaries.placeholder_type(F.col("f")).alias("kind"))


@query("""SELECT page_id, CASE WHEN length(t) = 0 THEN 'EMPTY' WHEN length(t) <> 16 THEN 'LENGTH' WHEN NOT regexp_matches(t, '^[0-9a-fA-F]{16}$') THEN 'NOT_HEXADECIMAL' END AS problem
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN left(md5(url), 16) WHEN 2 THEN md5(url) ELSE 'zz' || left(md5(url), 14) END AS t FROM pages)""")
def call_id_check(spark, sf_dir):
    """What is wrong with call ids, if anything."""
    h, k = F.md5("url"), F.col("page_id") % 4
    call = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit(" "), F.substring(h, 1, 16))).when(k == 2, h).otherwise(F.concat(F.lit("zz"), F.substring(h, 1, 14)))
    return table(spark, sf_dir, "pages").select("page_id", logs.call_id_problem(call).alias("problem"))


from voxledger.plans import log_queries  # noqa: E402, F401  registers the queries on log lines
