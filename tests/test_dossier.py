import json

from pyspark.sql import functions as F

from voxledger.operators import dossier
from voxledger.sources import logs, reports
from voxledger.streaming import tail

CALL = "00ab12cd34ef5678"


def line(n, message, level="INFO", call=CALL):
    return (n, f"2026-06-30T15:44:{n:02d}.068-03:00 ip-10-179-20-88 olos_ai_orchestrator[1604]: {level} - mod.ule - [User 11111111-2222-4333-8444-555555555555][CallId: {call}] {message}")


MESSAGES = [
    "Processando mensagem de texto: {'Nome': 'Synthetic', 'CPF': '000', 'OriginalPhoneNumber': '+1-202-555-0101', 'Valor': '12345,67', 'uui': 'WayIp=192.0.2.9', 'OutboundDnis': 'u@198.51.100.4'}",
    "Resposta do assistente: Hello there", "Parsed stage: 'Flow-ADA-ask_cpc'", "BUFFER LIMPO x transcrição='yes please'", "Resposta do assistente: Thank you", "Transitioning from 'A-first_one' to 'A-second_one'",
    'Opção escolhida: {"a": 1}, Confiança: 0.93', "First ElevenLabs chunk received - latency: 120 ms", "categorizer_client_call took 45.5ms", "Processing tool call: lookup", "TTS generation completed cache:HIT", "TTS generation completed cache:MISS",
    "Timeout de detecção de voz expirado", "Sequência de áudios repetida 3 vez", "Arquivo não encontrado: beep.wav", "WebSocket fechado após hangup por cliente",
    "Session summary: LLM:2 calls, 9t (in:5 out:4 cached:1), $0.25 ASR:3 calls, 1.5s audio, 20 chars TTS:4 calls, 30 chars, 5 chunks (600 bytes) Categorizer:7 calls", "TTS configured with eleven supplier", "Finalize response: yes", "Parsed stage: 'Flow-ADA-goodbye'", "nothing special",
]


def lines(spark):
    rows = [line(i, m) for i, m in enumerate(MESSAGES)] + [line(50, "ERROR - broken Resposta do assistente: hidden", "WARN"), line(51, "Resposta do assistente: other", call="ffff")]
    return spark.createDataFrame(rows, "line_no long, text string")


def test_all_dossiers_at_once(spark):
    got = {r["call_id"]: r for r in dossier.dossiers(dossier.lines_by_call(lines(spark))).collect()}
    d = got[CALL]
    assert (d["n_lines"], d["customer_name"], d["debt_total"], d["vpl_ip"], d["kamailio_ip"], d["orchestrator_ip"]) == (22, "Synthetic", "12345,67", "192.0.2.9", "198.51.100.4", "10.179.20.88")
    assert d["stage_sequence"] == ["ask_cpc", "goodbye"] and d["tts_latencies"] == [120] and d["categorizer_latencies"] == [45.5]
    assert (d["cache_hits"], d["cache_misses"], d["no_voice_timeouts"], d["audio_repetitions"], d["missing_audio_files"], d["hangup_reason"]) == (1, 1, 1, [3], ["beep"], "cliente")
    assert (d["session_summary"]["llm_cost"], d["session_summary"]["tts_bytes"], d["session_summary"]["categorizer_calls"]) == (0.25, 600, 7)
    assert len(d["errors"]) == 1 and d["tts_supplier"] == "eleven"
    assert got["ffff"]["n_lines"] == 1


def test_conversation_carries_the_stage(spark):
    found = dossier.events(dossier.lines_by_call(lines(spark)))
    said = [(r["speaker"], r["text"], r["stage"]) for r in dossier.conversation(found).where(F.col("call_id") == CALL).orderBy("line_no").collect()]
    assert said == [("assistant", "Hello there", None), ("customer", "yes please", None), ("assistant", "Thank you", "ask_cpc")]
    kinds = {r["line_no"]: (r["event_type"], r["content"]) for r in found.collect()}
    assert kinds[5] == ("STAGE_TRANSITION", "first_one -> second_one") and kinds[18] == ("FINALIZE_DECISION", "ENCERRAR") and kinds[20] == ("OTHER", "INFO - nothing special")
    assert kinds[50][0] == "ERROR" and kinds[0][1] == "[Mailing data received]"


def test_incomplete_summary_and_bad_literal(spark):
    rows = [line(1, "Session summary: LLM:2 calls"), line(2, "Processando mensagem de texto: {'broken'")]
    d = dossier.dossiers(dossier.lines_by_call(spark.createDataFrame(rows, "line_no long, text string"))).first()
    assert d["session_summary"] is None and d["mailing"] is None and d["customer_name"] is None


def test_prompts_are_repaired(spark):
    bad = "VocÃª Ã© um#012assistente"
    rows = [(bad,), ("plain",), ("日本 Ã",), ("caf\xe9",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(dossier.repaired_prompt(F.col("t"))).collect()]
    assert got == ["Você é um\nassistente", "plain", "日本 Ã", "café"]


def test_channel_turns(spark):
    turn = lambda **k: json.dumps({"asr_transcription": "", "ai_system": "s", "ai_milestone": "m-ask_it", "ai_hangup_call": False, **k})
    rows = [(1, f"2026-01-01 10:00:00.1234 98.43% [ALERT] jsmain.cpp:1332 [askADA] CALLID: ab targetContact.ada [AFTER]: {turn()}"), (2, f"x targetContact.ada [AFTER]: {turn(ai_system='NoInputHandler', ai_hangup_call=True)}"), (3, 'y WaySchInfo: {"NOME_CLIENTE": "Syn", "PRODUTO": "p"}'), (4, "[ChamadaFinalizada]")]
    df = spark.createDataFrame([("ab", *r) for r in rows], "call_id string, line_no long, text string")
    d = dossier.channel_dossiers(df).first()
    assert (d["n_turns"], d["no_inputs"], d["ai_hangup"], d["stage_sequence"], d["customer_name"], d["finished"]) == (2, 1, True, ["ask_it"], "Syn", True)
    assert dossier.is_channel_log(df).first()["is_vpl"]


def test_flow_stages(spark, tmp_path):
    flow = {"flows": [{"name": "x", "type": "start", "nodes": []}, {"name": "y", "type": "z", "nodes": [{"name": "one", "promptText": {"instruction": "do", "name": "p v2"}}, {"name": " "}, {"name": "two", "promptText": "plain"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(flow))
    (tmp_path / "b.json").write_text("not json")
    got = [(r["name"], r["version"], r["instruction"]) for r in logs.flow_stages(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [("one", "v2", "do"), ("two", None, "plain")]


def test_report_store(spark, tmp_path):
    store = reports.ReportStore(spark, str(tmp_path / "reports"))
    store.save("a", "first")
    store.save("b", "other")
    store.save("a", "second")
    rows = store.reports().collect()
    assert [(r["call_id"], r["report_text"]) for r in rows] == [("a", "second"), ("b", "other")]
    assert rows[0]["created_at"] < rows[0]["modified_at"]
    assert store.get("b").first()["report_text"] == "other"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(t for _, t in [line(i, m) for i, m in enumerate(MESSAGES)]))
    for name, make in (("activity", tail.activity), ("sessions", tail.call_sessions)):
        q = make(tail.follow(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("complete").start()
        try:
            q.processAllAvailable()
            assert spark.table(name).agg(F.sum("lines")).first()[0] == len(MESSAGES)
        finally:
            q.stop()


def test_channel_dossier_parts(spark):
    info = {"NOME_CLIENTE": "Synthetic", "valorDivida": "", "Valor": "10", "dtPrimeiraParcelaAtrasada": "2026-01-01", "dtTerceiraParcelaAtrasada": "2026-03-01", "valorConta1": "5", "CodigoPixConta3": "pix", "WayEngine": "eleven", "CampaignId": "c1", "VAgentName": "Ada"}
    texts = [
        "x WaySchInfo: " + json.dumps(info), 'x adaConversation: [{"user": "hi"}]', 'x adaConversation: [{"user": "hi", "assistant": "hello"}, {"assistant": "bye"}]', "x adaConversation: [broken]",
        "callDisposition [dispositionId: 42]", 'callDisposition: {"navigationDescription": "Promise", "x": 1}', "Hangup sofia [USER_BUSY]", "promptVoice: anna x", ' ERROR: CALLID: x real', ' ERROR: CALLID: x "error":""', "[ERR] y",
    ]
    table = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)] + [("other", 0, "Hangup NORMAL_CLEARING"), ("third", 0, "callDisposition [dispositionId: 7]")], "call_id string, line_no long, text string")
    got = {r["call_id"]: r for r in dossier.channel_dossiers(table).collect()}
    d = got["k"]
    assert (d["hangup_reason"], d["disposition"], d["n_errors"], d["debt_total"], d["tts_supplier"], d["tts_voice"], d["campaign_id"], d["agent_name"]) == ("USER_BUSY", "Promise", 2, "10", "eleven", "anna", "c1", "Ada")
    assert d["overdue_dates"] == ["2026-01-01", "2026-03-01"] and [tuple(a) for a in d["accounts"]] == [("5", None, None), (None, None, "pix")]
    assert (got["other"]["hangup_reason"], got["third"]["hangup_reason"]) == ("NORMAL_CLEARING", "disposition_7")
    said = [(r["speaker"], r["text"]) for r in dossier.channel_conversation(table).orderBy("place").collect()]
    assert said == [("customer", "hi"), ("assistant", "hello"), ("assistant", "bye")]


def test_course_of_a_channel_call(spark):
    at = "2026-01-01 10:00:0{}.123 98.43% [{}] jsmain.cpp:1 "
    speech = json.dumps({"asr_transcription": "yes", "ai_text_to_vocalize": "fine", "ai_milestone": "Flow-say_it", "ai_system": "s"})
    turn = lambda **k: json.dumps({"asr_transcription": "yes", "ai_system": "s", "ai_milestone": "m-ask_it", "ai_hangup_call": False, **k})
    texts = [
        at.format(1, "ALERT") + "detected-speech parsedBody: " + speech, at.format(2, "ALERT") + "targetContact.ada [AFTER]: " + turn(), at.format(3, "ALERT") + "targetContact.ada [AFTER]: " + turn(ai_milestone="no_input_timeout_1", ai_hangup_call=True),
        at.format(4, "ALERT") + "[ChamadaFinalizada]", "11111111-2222-4333-8444-555555555555 " + at.format(5, "ERR") + "CALLID: 0a1b it  broke [ERR]", "no time detected-speech parsedBody: " + speech, at.format(6, "INFO") + "detected-speech parsedBody: {broken}", "[ERR] no time", at.format(7, "INFO") + "nothing",
    ]
    table = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], "call_id string, line_no long, text string")
    got = [(r["line_no"], r["event_type"], r["content"]) for r in dossier.channel_events(table).orderBy("line_no", "place").collect()]
    assert got == [
        (0, "ASR_TRANSCRIPTION", "yes"), (0, "BOT_RESPONSE", "fine"), (0, "STAGE_TRANSITION", "→ say_it"), (1, "STAGE_TRANSITION", "→ ask_it"), (2, "VOICE_DETECTION", dossier.SILENT), (2, "FINALIZE_DECISION", dossier.HANGING_UP),
        (3, "FINALIZE_DECISION", dossier.ENDED), (4, "ERROR", "ERR - it  broke [ERR]"),
    ]
