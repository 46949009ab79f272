"""Small reducers over entries, evidence and dossiers, and the JSON form of any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Which of a file's failures is told, from least to most telling.
FAILURE_ORDER = ("CONTINUACAO_ORFA", "CABECALHO_APARENTE_INVALIDO", "INVALID_UTF8", "FILE_READ_ERROR", "SOURCE_CHANGED")


def main_failure(failures: DataFrame, group: str, code: str, order: str, priorities: tuple[str, ...] = FAILURE_ORDER) -> DataFrame:
    """The most telling failure of each group; of equal ones the first."""
    place = F.create_map(*[F.lit(x) for i, c in enumerate(priorities) for x in (c, i)])
    rank = F.coalesce(place[F.col(code)], F.lit(-1))
    return failures.groupBy(group).agg(F.max_by(code, F.struct(rank, -F.col(order))).alias("failure"))


def representative(occurrences: DataFrame, node: list[str], order: list[str]) -> DataFrame:
    """One occurrence for each node: the least in a total order."""
    rest = [c for c in occurrences.columns if c not in node]
    return occurrences.groupBy(*node).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*node, "__r.*")


def missing(have: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Keys asked for that nothing has."""
    return wanted.select(key).subtract(have.select(key))


def first_match(references: DataFrame, entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """References with the first entry each one points to."""
    first = entries.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in entries.columns if c not in keys]), F.struct(*order)).alias("entry"))
    return references.join(first, keys, "left")


def located(references: DataFrame, entries: DataFrame) -> DataFrame:
    """References (file_token, entry_id, line_start, line_end and more) with the application of the entry whose lines
    hold theirs; null if none does, or if entries of several applications do."""
    own, lines = ["file_token", "entry_id"], ["line_start", "line_end"]
    held = entries.select(*own, F.col("app").alias("__app"), F.col("line_start").alias("__from"), F.col("line_end").alias("__to"))
    hits = references.select(*own, *lines).distinct().join(held, own).where("__from <= line_start AND line_end <= __to")
    sure = hits.groupBy(*own, *lines).agg(F.min("__app").alias("app"), F.max("__app").alias("__last")).where("app = __last").drop("__last")
    return references.join(sure, [*own, *lines], "left")


def latency_card(dossiers: DataFrame) -> DataFrame:
    """Mean and greatest speech latency and mean categoriser latency of each call, and its longest repetition."""
    mean = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(c))
    return dossiers.select("call_id", mean("tts_latencies").alias("tts_mean"), F.array_max("tts_latencies").alias("tts_max"), mean("categorizer_latencies").alias("categorizer_mean"), F.array_max("audio_repetitions").alias("most_repetitions"))


def significant_warnings(lines: DataFrame) -> DataFrame:
    """Warning lines that tell of a timeout, an error, something not found or a failure."""
    low = F.lower("text")
    return lines.where(F.contains("text", F.lit("WARNING -")) & (F.contains(low, F.lit("timeout")) | F.contains(low, F.lit("error")) | F.contains(low, F.lit("não encontrado")) | F.contains(low, F.lit("falha"))))


def shown_fields(document: Column) -> Column:
    """A mailing document's fields that say something."""
    return F.map_filter(F.from_json(document, "map<string,string>"), lambda k, v: v.isNotNull() & ~v.isin("", "None", "NULL", "False", "false"))


def by_token_number(errors: DataFrame) -> DataFrame:
    """Errors in the order of their files' numbers."""
    return errors.orderBy(F.regexp_extract("file_token", r"(\d+)", 1).try_cast("int"), "file_token")


#: Types that have a JSON form of their own, and how times are written.
_PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_TIMES = {T.TimestampType: "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", T.TimestampNTZType: "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", T.DateType: "yyyy-MM-dd"}


def _json_form(value: Column, kind: T.DataType, at: str) -> Column:
    """The value as types that JSON has, in order; a kind without such a form is an error before any row is read."""
    if isinstance(kind, T.StructType):
        names = [f.name for f in kind.fields]
        if len(set(names)) < len(names):
            raise ValueError(f"{at}: two fields have one name")
        made = F.struct(*[_json_form(value[f.name], f.dataType, f"{at}.{f.name}").alias(f.name) for f in kind.fields]) if names else value
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _json_form(x, kind.elementType, f"{at}[]"))
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError(f"{at}: keys of type {kind.keyType.simpleString()} have no JSON form")
        return F.transform_values(value, lambda _, x: _json_form(x, kind.valueType, f"{at}{{}}"))
    if (form := _TIMES.get(type(kind))) is not None:
        return F.date_format(value, form)
    if not isinstance(kind, _PLAIN):
        raise TypeError(f"{at}: type {kind.simpleString()} has no JSON form")
    return value


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON with its fields in order; nulls are kept, times are ISO 8601. Types without a JSON form, map keys
    that aren't text and names that occur twice are errors when the plan is made."""
    if len(set(df.columns)) < len(df.columns):
        raise ValueError("two columns have one name")
    made = F.struct(*[_json_form(df[f"`{f.name}`"], f.dataType, f.name).alias(f.name) for f in df.schema.fields])
    return df.select(F.to_json(made, {"ignoreNullFields": "false"}).alias("json"))


def placeholder_type(field: Column) -> Column:
    """The kind of sensitive value that a field's name announces."""
    name = F.regexp_replace(F.lower(field), r"[^a-z0-9]", "")
    return (
        F.when(name.rlike("callid$|^callid|sipchanneluser"), "CALL_ID").when(name.rlike("channeluuid"), "UUID_CANAL").when(name.rlike("sessionuuid|sessionid"), "UUID_SESSAO").when(name.rlike("uuid"), "UUID")
        .when(name.rlike("phone|telefone|ani$|dnis|msisdn"), "TELEFONE").when(name.rlike("cpf|cnpj|documento"), "DOCUMENTO").when(name.rlike("ip$|ipaddress"), "IP").when(name.rlike("host"), "HOST_INTERNO")
        .when(name.rlike("url"), "URL_INTERNA").when(name.rlike("senha|password|token|secret|apikey"), "CREDENCIAL").when(name.rlike("nome|name|email|endereco|address"), "DADO_CLIENTE")
    )
