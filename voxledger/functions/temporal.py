"""Local and offset time stamps to UTC, failing instead of guessing. The session zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.functions.steps import Steps, take

CHANNEL_ZONE = "America/Sao_Paulo"

#: Failure codes.
INVALID = "TEMPORAL_TIMESTAMP_INVALIDO"
PRECISION = "TEMPORAL_PRECISAO_NAO_SUPORTADA"
NONEXISTENT = "TEMPORAL_HORARIO_INEXISTENTE"
AMBIGUOUS = "TEMPORAL_HORARIO_AMBIGUO"
NO_OFFSET = "TEMPORAL_OFFSET_AUSENTE"

LOCAL = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?$"
OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"


def fraction_digits(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"\.(\d+)", 1))


def _result(utc: Column, digits: Column, failure: Column) -> Column:
    ok = failure.isNull()
    return F.struct(F.when(ok, utc).alias("utc"), F.when(ok, digits).alias("precision"), failure.alias("failure"))


def _timed(text: Column, form: Column, digits: Column) -> Column:
    return F.try_to_timestamp(F.when(form & (digits <= 6), text))


def _local_failure(text: Column, form: Column, digits: Column, wall: Column, utc: Column, zone: str) -> Column:
    hour = F.expr("interval 1 hour")
    twice = (F.from_utc_timestamp(utc + hour, zone) == wall) | (F.from_utc_timestamp(utc - hour, zone) == wall)
    return (
        F.when(text.isNull() | ~form, INVALID)
        .when(digits > 6, PRECISION)
        .when(wall.isNull(), INVALID)
        .when(F.from_utc_timestamp(utc, zone) != wall, NONEXISTENT)
        .when(twice, AMBIGUOUS)
    )


def _offset_failure(text: Column, form: Column, digits: Column, stamp: Column) -> Column:
    return (
        F.when(text.isNull(), INVALID)
        .when(~form & text.rlike(LOCAL), NO_OFFSET)
        .when(~form, INVALID)
        .when(digits > 6, PRECISION)
        .when(stamp.isNull(), INVALID)
    )


def local_to_utc(text: Column, zone: str = CHANNEL_ZONE) -> Column:
    """struct(utc, precision, failure) of a wall-clock text. A wall time that the zone skips, or has twice, fails."""
    form, digits = text.rlike(LOCAL), fraction_digits(text)
    wall = _timed(text, form, digits)
    utc = F.to_utc_timestamp(wall, zone)
    return _result(utc, digits, _local_failure(text, form, digits, wall, utc, zone))


def offset_to_utc(text: Column) -> Column:
    """struct(utc, precision, failure) of an ISO text with its own offset."""
    form, digits = text.rlike(OFFSET), fraction_digits(text)
    stamp = _timed(text, form, digits)
    return _result(stamp, digits, _offset_failure(text, form, digits, stamp))


def utc_steps(text: Column, local: Column, name: str, zone: str = CHANNEL_ZONE) -> Steps:
    """The steps to `name`: local_to_utc() of a text where `local` is true, else offset_to_utc(). Each step is a column of its
    own, so that it is made once for a text: written out in one, a time would be matched, parsed and shifted some thirty times."""
    t, own, form, digits, time, utc, failure = (F.col(f"__utc_{c}") for c in ("text", "local", "form", "digits", "time", "utc", "failure"))
    steps = {
        "text": text, "local": local, "form": F.when(own, t.rlike(LOCAL)).otherwise(t.rlike(OFFSET)), "digits": fraction_digits(t), "time": _timed(t, form, digits),
        "utc": F.when(own, F.to_utc_timestamp(time, zone)).otherwise(time),
        "failure": F.when(own, _local_failure(t, form, digits, time, utc, zone)).otherwise(_offset_failure(t, form, digits, time)),
    }
    return [*({f"__utc_{step}": made} for step, made in steps.items()), {name: _result(utc, digits, failure)}]


def with_utc(rows: DataFrame, text: Column, local: Column, name: str, zone: str = CHANNEL_ZONE) -> DataFrame:
    """rows with `name`, see utc_steps()."""
    steps = utc_steps(text, local, name, zone)
    return take(rows, steps).drop(*[c for step in steps for c in step if c != name])


def utc_text(utc: Column, precision: Column) -> Column:
    """ISO text in UTC with as many fraction digits as the source had."""
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.substring(F.date_format(utc, "SSSSSS"), F.lit(1), precision)
    return F.concat(whole, F.when(precision > 0, F.concat(F.lit("."), fraction)).otherwise(""), F.lit("+00:00"))
