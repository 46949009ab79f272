"""Where header fields stand in a block's text: character spans and lines, for provenance."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from voxledger.operators import headers

#: The fields of each format in order, with their groups in its header pattern.
FIELDS = {
    "vpl-real": (("ChannelUuid", 1), ("timestamp", 2), ("percentual_operacional", 3), ("severidade", 4), ("origem", 5), ("mensagem", 6)),
    "vpl-legado": (("timestamp", 1), ("severidade", 2), ("origem", 3), ("mensagem", 4)),
    "ork-real": (("timestamp", 1), ("host", 2), ("processo", 3), ("pid", 4), ("severidade", 5), ("logger", 6), ("mensagem", 7)),
    "ork-legado": (("timestamp", 1), ("severidade", 2), ("mensagem", 3)),
}
_PATTERNS = {k: re.compile(p) for k, p in {"vpl-real": headers.VPL_REAL, "vpl-legado": headers.VPL_LEGACY, "ork-real": headers.ORK_REAL, "ork-legado": headers.ORK_LEGACY}.items()}

SPAN = T.StructType([T.StructField("name", T.StringType()), T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType()), T.StructField("line_start", T.LongType()), T.StructField("line_end", T.LongType()), T.StructField("rule", T.StringType())])
_ARROW = pa.list_(pa.struct([("name", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("line_start", pa.int64()), ("line_end", pa.int64()), ("rule", pa.string())]))


def spans_of(text: str | None, form: str | None, first_line: int) -> list[dict]:
    """Spans of the header's fields; lines count from the block's first line."""
    m = _PATTERNS[form].match(text) if text is not None and form in _PATTERNS else None
    out = []
    for name, group in FIELDS[form] if m else ():
        if m[group] is not None:
            a, b = m.span(group)
            app, kind = form.split("-")
            line = first_line + text.count("\n", 0, a)
            out.append({"name": name, "span_start": a, "span_end": b, "line_start": line, "line_end": line + text[a:b].rstrip("\r\n").count("\n"), "rule": f"{app}.cabecalho.{kind}.v1"})
    return out


@arrow_udf(T.ArrayType(SPAN))
def _spans(text: pa.Array, form: pa.Array, line: pa.Array) -> pa.Array:
    return pa.array([spans_of(*x) for x in zip(text.to_pylist(), form.to_pylist(), line.to_pylist(), strict=True)], _ARROW)


def field_spans(text: Column, form: Column, line_start: Column) -> Column:
    """array<struct> of the provenance of a parsed block's fields."""
    return _spans(text, form, line_start.cast("long"))
