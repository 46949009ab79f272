import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxledger.operators import summaries


def test_latency_card(spark):
    df = spark.createDataFrame([("a", [100, 300], [1.5], [2, 5]), ("b", [], [], [])], "call_id string, tts_latencies array<long>, categorizer_latencies array<double>, audio_repetitions array<long>")
    got = {r["call_id"]: tuple(r)[1:] for r in summaries.latency_card(df).collect()}
    assert got == {"a": (200.0, 300, 1.5, 5), "b": (None, None, None, None)}


def test_warnings_and_fields(spark):
    lines = spark.createDataFrame([("WARNING - m - timeout here",), ("WARNING - m - fine",), ("INFO - timeout",), ("WARNING - x Não encontrado",)], "text string")
    assert summaries.significant_warnings(lines).count() == 2
    row = spark.createDataFrame([('{"a":"1","b":"","c":null,"d":"None","e":"x"}',)], "d string").select(summaries.shown_fields(F.col("d")).alias("m")).first()
    assert row["m"] == {"a": "1", "e": "x"}


def test_errors_by_number(spark):
    df = spark.createDataFrame([("<ARQUIVO_10>",), ("<ARQUIVO_2>",)], "file_token string")
    assert [r[0] for r in summaries.by_token_number(df).collect()] == ["<ARQUIVO_2>", "<ARQUIVO_10>"]


def test_types_of_fields(spark):
    names = ["TelecomCallId", "ChannelUuid", "session_id", "OriginalPhoneNumber", "CPF", "vpl_ip", "WayHost", "api_key", "NOME_CLIENTE", "other"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(summaries.placeholder_type(F.col("n"))).collect()]
    assert got == ["CALL_ID", "UUID_CANAL", "UUID_SESSAO", "TELEFONE", "DOCUMENTO", "IP", "HOST_INTERNO", "CREDENCIAL", "DADO_CLIENTE", None]


def test_references_are_located_by_lines_and_by_one_application(spark):
    entries = spark.createDataFrame([("f", "e1", "VPL", 1, 3), ("f", "e2", "VPL", 4, 6), ("f", "e2", "ORK", 4, 6)], "file_token string, entry_id string, app string, line_start int, line_end int")
    refs = spark.createDataFrame([(1, "f", "e1", 2, 3), (2, "f", "e1", 3, 4), (3, "f", "e2", 4, 4), (4, "g", "e1", 1, 1), (5, "f", "e1", 2, 3)], "n int, file_token string, entry_id string, line_start int, line_end int")
    assert {r["n"]: r["app"] for r in summaries.located(refs, entries).collect()} == {1: "VPL", 2: None, 3: None, 4: None, 5: "VPL"}


def test_json_of_any_type_or_an_error_before_any_row(spark):
    row = (1, None, [("x", 2.5), None], {"k": None, "l": "v"}, datetime.datetime(2025, 1, 2, 3, 4, 5, 6000), datetime.date(2025, 1, 2), True)
    kinds = "a long, b string, c array<struct<z: string, y: double>>, m map<string, string>, t timestamp, d date, e boolean"
    df = spark.createDataFrame([row, (None,) * 7], kinds)
    got = [json.loads(r[0]) for r in summaries.json_rows(df).collect()]
    assert got[0] == {"a": 1, "b": None, "c": [{"z": "x", "y": 2.5}, None], "m": {"k": None, "l": "v"}, "t": "2025-01-02T03:04:05.006000Z", "d": "2025-01-02", "e": True}
    assert list(got[0]) == list("abcmtde") and got[1] == dict.fromkeys("abcmtde")
    for kind in ("binary", "map<int, string>", "array<map<double, int>>", "interval day to second", "struct<x: decimal(10, 2)>"):
        with pytest.raises(TypeError, match="JSON"):
            summaries.json_rows(spark.createDataFrame([], f"v {kind}"))
    two = T.StructType([T.StructField("s", T.StructType([T.StructField("x", T.LongType()), T.StructField("x", T.LongType())]))])
    with pytest.raises(ValueError, match="one name"):
        summaries.json_rows(spark.createDataFrame([], two))
    with pytest.raises(ValueError, match="one name"):
        summaries.json_rows(df.select("a", F.col("b").alias("a")))
