import itertools
import random
import re

from pyspark.sql import functions as F

from voxledger.llm import quotations as t

SCHEMA = "conv_id long, turn long, role string, text string, root string, level string"


def plain(messages):
    """Links, roots and order, message by message."""

    def lines(text):
        out = []
        for line in (text or "").split("\n"):
            marks = re.match(r"[ \t]*((?:>[ \t]?)+)", line)
            body = line[marks.end() :] if marks else line
            out.append((marks.group(1).count(">") if marks else 0, re.sub(r"[\W_]+", " ", body.lower()).strip()))
        runs = [list(g) for _, g in itertools.groupby(out, key=lambda x: (x[0], x[1] == ""))]
        out += [(run[0][0], " ".join(p for _, p in run)) for run in runs if len(run) > 1]
        return [(n, p) for n, p in out if p.strip()]

    first = {}
    for conv, turn, _, text, *_ in messages:
        if turn is not None:
            for n, p in lines(text):
                if n == 0:
                    first[conv, p] = min(turn, first.get((conv, p), turn))
    best = {}
    for conv, turn, _, text, *_ in messages:
        for n, p in lines(text):
            o = first.get((conv, p))
            if turn is not None and n and o is not None and o < turn:
                best[conv, turn] = max(best.get((conv, turn), (False, -99, 0)), (len(p.split(" ")) >= 3 or len(p) >= 12, -n, o))
    reply = {m: o for m, (*_, o) in best.items()}

    def root(conv, turn):
        while (conv, turn) in reply:
            turn = reply[conv, turn]
        return turn

    return {(c, n): (reply.get((c, n)), root(c, n)) for c, n, *_ in messages}


def conversations(seed=1):
    rng = random.Random(seed)
    out = []
    for conv in range(6):
        said = []
        for turn in range(25 if conv else 60):
            text = []
            for _ in range(rng.randrange(3)):
                if said:
                    depth = rng.choice([1, 1, 2])
                    if rng.random() < 0.5:
                        text.append("On Monday, someone wrote:")
                    text.append("> " * depth + rng.choice(said).upper())
            own = f"{rng.choice(['alpha', 'beta'])} says {rng.randrange(40)} things"
            said.append(own)
            out.append((conv, turn, "user", "\n".join([*text, own]), "r", "l"))
    return out + [(None, 0, "user", "lost and found things", "r", "l"), (None, 1, None, ">lost and found THINGS!\nok", "r", "l"), (7, None, "user", "no turn at all", "r", "l"), (7, 0, None, None, "r", "l"), (7, 1, "user", "", "r", "l"), (7, 1, "user", "again at one", "r", "l")]


def test_against_plain(spark):
    rows = conversations()
    got = t.threads(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    want = plain(rows)
    assert sum(w[0] is not None for w in want.values()) > 20
    for r in got:
        assert (r["reply_to"], r["root"]) == want[r["row"]["conv_id"], r["row"]["turn"]]
    by = {}
    for r in got:
        by.setdefault(r["row"]["conv_id"], []).append((r["position"], r["root"] if r["root"] is not None else -1, r["row"]["turn"] if r["row"]["turn"] is not None else -1))
    for own in by.values():
        own.sort()
        assert [p for p, *_ in own] == list(range(1, len(own) + 1))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_clean_text(spark):
    text = "Hi,\nOn Tuesday, Kim wrote:\n> old words here\n> > older words there\n\nMy answer > yours\nHe wrote:\nno quote follows"
    row = t.threads(spark.createDataFrame([(1, 0, "user", text, "r", "l")], SCHEMA)).first()
    assert row["clean"] == "Hi,\n\nMy answer > yours\nHe wrote:\nno quote follows"
    assert (row["n_quoted"], row["levels"], row["n_linked"], row["row"]["root"]) == (2, 2, 0, "r")


def test_long_chain_and_hot_conversation(spark):
    rows = [(1, 0, "u", "message number 0", "r", "l")] + [(1, i, "u", f"> message number {i - 1}\nmessage number {i}", "r", "l") for i in range(1, 300)]
    got = t.threads(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["root"] for r in got} == {0}
    assert [r["row"]["turn"] for r in sorted(got, key=lambda r: r["position"])] == list(range(300))


def test_wrapped_and_short_quotes_are_linked(spark):
    first = "The quick brown fox jumps over\nthe lazy dog and runs away\n\nSecond paragraph here"
    again = "> The quick brown fox\n> jumps over the lazy dog\n> and runs away\nIndeed."
    rows = [(1, 0, "u", first), (1, 1, "a", "Unrelated words"), (1, 2, "u", again), (1, 3, "a", "> Indeed\nGood"), (1, 4, "u", ">good\n> unrelated WORDS\n好的"), (1, 5, "a", "> 好的")]
    got = {r["row"]["turn"]: (r["reply_to"], r["root"]) for r in t.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0), 1: (None, 1), 2: (0, 0), 3: (2, 0), 4: (1, 1), 5: (4, 1)}


def test_one_conversation_and_rows_without_turn_are_dealt_over_tasks(spark):
    """All rows are of one conversation, half of them without a turn and some equal: no bucket holds most."""
    n = 4000
    rows = spark.range(n).select(F.lit(5).alias("conv_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("turn"), F.lit("u").alias("role"), F.concat(F.lit("text "), F.floor(F.col("id") / 3)).alias("text"))
    seen, real = [], t.running_sum

    def spy(df, *rest):
        seen.append(df.groupBy("bucket").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0])
        return real(df, *rest)

    t.running_sum = spy
    try:
        got = t.threads(rows).collect()
    finally:
        t.running_sum = real
    assert seen[0] < 0.6 * n
    assert sorted(r["position"] for r in got) == list(range(1, n + 1))
    assert {r["row"]["turn"] for r in got if r["position"] <= n // 2} == {None}


def test_clashing_names_and_a_long_text(spark):
    names = ["c", "t", "t0", "h", "row", "n", "root", "position", "clean"]
    table = spark.createDataFrame([(1, i, "u", "some words\n" * (100_000 if i == 1 else 2), *names) for i in range(3)], ["conv_id", "turn", "role", "text", *names])
    got = t.threads(table).collect()
    assert sorted((r["position"], r["row"]["turn"], r["row"]["root"]) for r in got) == [(1, 0, "root"), (2, 1, "root"), (3, 2, "root")]


def test_empty_table(spark):
    assert t.threads(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_keeps_turns_where_nothing_is_quoted(spark, medium):
    got = t.op7_quotation_threads(spark, medium).collect()
    assert len(got) == spark.read.parquet(f"{medium}/conversations.parquet").count()
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append((r.position, r.turn))
    assert all([n for _, n in sorted(v)] == sorted(n for _, n in v) for v in by.values())


def test_sql_form_on_quotes(spark, tmp_path):
    import duckdb

    rows = [(c, n, r, x) for c, n, r, x, *_ in conversations(2) if n is not None and (c, n) != (7, 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    cur = con.execute(t.ORACLE)
    names = [d[0] for d in cur.description]
    df = t.op7_quotation_threads(spark, str(tmp_path))
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in df.collect())


def test_equal_messages_and_messages_without_a_role(spark):
    """A third of all messages are equal: they are numbered one by one, and no task places them all."""
    rows = [(1, 4, "user", "the same words again and again", "x", "y")] * 600 + [(1, i, None, f"message number {i} with words", "x", "y") for i in range(5, 1205)] + [(None, None, None, None, None, None)] * 3
    rows += [(1, 2000, None, "> the same words again and again\nyes", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = t.threads(df).collect()
    assert len(got) == len(rows)
    assert sorted(r["position"] for r in got if r["row"]["conv_id"] == 1) == list(range(1, 1802))
    assert sorted(r["position"] for r in got if r["row"]["conv_id"] is None) == [1, 2, 3]
    same = sorted(r["position"] for r in got if r["row"]["turn"] == 4)
    assert same == list(range(same[0], same[0] + 600))
    reply = next(r for r in got if r["row"]["turn"] == 2000)
    assert (reply["reply_to"], reply["clean"]) == (4, "yes")
