"""Technical identifiers in log entries: extraction with spans, normalisation and comparison namespaces."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

#: Which identifier types are comparable with each other.
NAMESPACES = {"chamada_externa": "chamada_externa", "telecom_call_id": "chamada_externa", "call_id": "chamada_externa", "sip": "sip", "uuid_canal": "uuid_canal", "uuid_sessao": "uuid_sessao"}
UUID_TYPES = ("uuid_canal", "uuid_sessao")
#: Pairs of marks that may enclose a value.
PAIRS = {'"': '"', "'": "'", "<": ">", "[": "]", "(": ")", "{": "}"}
#: Names of the extraction rules.
RULES = {
    ("VPL", "prefix"): "vpl.uuid-canal-prefixo.v1", ("VPL", "call"): "vpl.identificador-chamada-rotulado.v1", ("VPL", "sip"): "vpl.canal-sip-usuario.v1",
    ("VPL", "channel"): "vpl.uuid-canal-rotulado.v1", ("VPL", "session"): "vpl.uuid-sessao-rotulado.v1", ("ORK", "telecom"): "ork.telecom-identificador-chamada.v1",
    ("ORK", "call"): "ork.identificador-chamada.v1", ("ORK", "session"): "ork.uuid-sessao-rotulado.v1",
}

#: The syntax of a labelled value, and of the labels.
_VALUE = r"""(?P<value>"[^"\r\n]+"|'[^'\r\n]+'|<[^<>\r\n]+>|\[[^\[\]\r\n]+\]|\([^()\r\n]+\)|\{[^{}\r\n]+\}|[^\s,;}\]\)\r\n]+)"""
_LABEL = r"""(?<!\w)(?P<quote>["']?)(?P<name>%s)(?P=quote)\s*(?:=|:)\s*"""
_VPL_CALL = re.compile(_LABEL % "CALLID|CallId|call-id" + _VALUE)
_VPL_UUID = re.compile(_LABEL % "channel(?:[_-]?uuid)|session(?:[_-]?(?:uuid|id))" + _VALUE, re.IGNORECASE)
_SIP = re.compile(r"(?<![\w/])sofia/(?P<profile>[A-Za-z0-9_.-]+)/(?P<value><[^<>\s/@]+>|[^<>\s/@,;]+)@(?P<to>[^\s,;]+)", re.IGNORECASE)
_ORK_CALL = re.compile(_LABEL % "TelecomCallId|CallId" + _VALUE)
_ORK_SESSION = re.compile(_LABEL % "session(?:_?uuid|_?id)" + _VALUE, re.IGNORECASE)


def peel(text: str) -> str:
    """The text without outer spaces and outer pairs of marks, as often as there are some."""
    out = text.strip()
    while len(out) >= 2 and PAIRS.get(out[0]) == out[-1]:
        out = out[1:-1].strip()
    return out


def normalize(kind: str, value: str) -> str | None:
    """The comparable form; None where nothing is left or a UUID isn't one."""
    plain = peel(value).casefold()
    if kind in UUID_TYPES:
        try:
            uuid.UUID(plain)
        except ValueError:
            return None
    return plain or None


def normalize_query(query: str) -> str:
    """The query's comparable form, or its stripped text if peeling leaves nothing."""
    return peel(query).casefold() or query.strip()


def check_query(query: str) -> str | None:
    """What is wrong with a query, before anything is read: empty, blank or over 256 characters."""
    return "EMPTY_QUERY" if query == "" else "BLANK_QUERY" if not query.strip() else "QUERY_TOO_LONG" if len(query) > 256 else None


def _labelled(app: str, text: str) -> list[tuple[str, str, str, str, int, int]]:
    """(type, field, value, rule, start, end) of each labelled value, pattern by pattern."""
    found = []
    for pattern in (_VPL_CALL, _SIP, _VPL_UUID) if app == "VPL" else (_ORK_CALL, _ORK_SESSION):
        for m in pattern.finditer(text):
            if pattern is _SIP:
                kind, name, rule = "chamada_externa", "SipChannelUser", "sip"
            else:
                name = m["name"]
                rule = "telecom" if name == "TelecomCallId" else "call" if pattern in (_VPL_CALL, _ORK_CALL) else "channel" if name.casefold().startswith("channel") else "session"
                kind = {"telecom": "telecom_call_id", "call": "call_id", "channel": "uuid_canal", "session": "uuid_sessao"}[rule]
            found.append((kind, name, m["value"], RULES[app, rule], *m.span("value")))
    return found


IDENTIFIER = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "namespace", "field", "original", "normalized", "rule")] + [T.StructField(n, T.IntegerType()) for n in ("span_start", "span_end", "line_offset")]
)
_ARROW = pa.list_(pa.struct([(n, pa.string()) for n in ("type", "namespace", "field", "original", "normalized", "rule")] + [(n, pa.int32()) for n in ("span_start", "span_end", "line_offset")]))


def _found(app: str, text: str | None, region: int, prefix: str | None) -> Iterator[tuple]:
    """The identifiers of a block's text, each as the values of IDENTIFIER."""
    found = [] if not prefix else [("uuid_canal", "ChannelUuid", prefix, RULES["VPL", "prefix"], 0, len(prefix))]
    if text is not None and region is not None and region >= 0:
        found += [(k, n, v, r, a + region, b + region) for k, n, v, r, a, b in _labelled(app, text[region:])]
    for kind, name, value, rule, start, end in found:
        if (plain := normalize(kind, value)) is not None:
            yield kind, NAMESPACES[kind], name, value, plain, rule, start, end, text.count("\n", 0, start) if text else 0


def identifiers_of(app: str, text: str | None, region: int, prefix: str | None) -> list[dict]:
    """Identifiers of a block's text from character `region` on, after the channel UUID that may lead it.
    line_offset counts the lines of the block before the value."""
    return [dict(zip(IDENTIFIER.names, found, strict=True)) for found in _found(app, text, region, prefix)]


@arrow_udf(T.ArrayType(IDENTIFIER))
def _identifiers(app: pa.Array, text: pa.Array, region: pa.Array, prefix: pa.Array) -> pa.Array:
    ends, rows = [0], []
    for a, t, r, p in zip(app.to_pylist(), text.to_pylist(), region.to_pylist(), prefix.to_pylist(), strict=True):
        if t is not None or p:
            rows += _found(a, t, r, p)
        ends.append(len(rows))
    columns = zip(*rows, strict=True) if rows else [()] * len(IDENTIFIER)
    each = [pa.array(c, f.type) for c, f in zip(columns, _ARROW.value_type, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(each, fields=list(_ARROW.value_type)), type=_ARROW)


def identifiers(app: Column, text: Column, region: Column, prefix: Column) -> Column:
    """array<struct> of a block's identifiers; region is where its searchable part begins. Texts without any label's
    beginning (a JVM test) aren't sent to Python."""
    # told not to be deterministic, it is run once for an entry: else a filter on what it finds, which the optimizer adds
    # to each explode(), would run it again
    return _identifiers.asNondeterministic()(app, F.when(text.rlike("(?iU)call|sofia/|channel|session"), text), region.cast("int"), prefix)


@arrow_udf(T.StringType())
def _casefold(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.casefold() for x in text.to_pylist()], pa.string())


def casefold(text: Column) -> Column:
    """Full case folding (ß as ss), which lower() isn't, except for ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(_casefold(F.when(~plain, text)))


def normalized_sql(value: Column) -> Column:
    """The comparable form with built-in functions: outer pairs peeled as often as there are some (half the length
    at most), lower case instead of folding."""

    def once(text: Column, _: Column) -> Column:
        pair = F.lit(False)
        for a, b in PAIRS.items():
            pair = pair | (text.startswith(a) & text.endswith(b))
        return F.when(pair & (F.length(text) >= 2), F.trim(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)

    most = F.coalesce(F.floor(F.length(value) / 2), F.lit(0)) + 1
    return F.lower(F.aggregate(F.sequence(F.lit(1).cast("long"), most), F.trim(value), once))
