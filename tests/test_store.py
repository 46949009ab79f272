"""Tables on the way: where they are, and that they go."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from voxledger.functions import prefix, store
from voxledger.operators import secure
from voxledger.plans import scenario


def folders(spark):
    base = Path(store.shared_dir(spark).removeprefix("file:").replace("//", "/")).parent
    return {p.name for p in base.glob("vox-*")} if base.exists() else set()


def test_scratch_takes_tables_away_and_keeps_results(spark):
    before = folders(spark)
    with store.scratch(spark) as keep:
        first = store.materialize(spark.range(5))
        with store.scratch(spark) as inner:
            second = inner(store.materialize(first.where("id > 1")))
        kept = keep(second.where("id > 2"))
        assert second.count() == 3
    assert sorted(r[0] for r in kept.collect()) == [3, 4]
    assert len(folders(spark) - before) == 1


def test_an_answer_leaves_nothing_behind(spark, tmp_path):
    (tmp_path / "vpl.log").write_text("2025-01-15 10:00:00.000000 0% [INFO] source CallId=abc rest\n")
    before = folders(spark)
    with scenario.answer(spark, "abc", [("VPL", str(tmp_path / "vpl.log"))]) as found:
        assert found.timeline.count() == 1
        assert "query:\n  CALL_ID <CALL_ID_1> (1)" in scenario.report(found)
    view = secure.secure_texts(spark.createDataFrame([("a", 1, "at 192.0.2.1")], "analysis_id string, seq int, text string"))
    assert view.first()["safe"] == "at <IP_1>"
    left = folders(spark) - before
    assert len(left) <= 2  # the view itself, and the numbers of lines that the reader counted


def session(master, setting=None):
    conf = SimpleNamespace(get=lambda key, default=None: setting or default)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=conf)


def test_without_the_setting_only_one_machine_has_a_folder(monkeypatch):
    monkeypatch.setattr(store, "_LOCAL", [])
    one, two = store.shared_dir(session("local[4]")), store.shared_dir(session("local"))
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0] and one.startswith("file:///")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="checkpoint"):
            store.shared_dir(session(master))
        assert store.shared_dir(session(master, "hdfs://x/y")).startswith("hdfs://x/y/vox-")


def test_scans_in_buckets_equal_plain_ones(spark):
    rows = [(g, i, None if (i * 7 + len(g)) % 3 else f"{g}{i}") for g in ("a", "bb", "c") for i in range(50)]
    df = spark.createDataFrame([*rows, (None, 3, "n"), (None, 4, None)], "g string, i long, v string").selectExpr("*", "i div 4 AS b")
    got = {(r["g"], r["i"]): (r["last"], r["near"]) for r in prefix.previous(prefix.last_so_far(df, ["g"], ["b"], ["i"], df["v"], "last"), ["g"], ["b"], ["i"], "v", "near").collect()}
    last, near, of = None, None, object()
    for g, i, v in [*rows, (None, 3, "n"), (None, 4, None)]:
        if g != of:
            last, near, of = None, None, g
        last = v if v is not None else last
        assert got[g, i] == (last, near)
        near = v
