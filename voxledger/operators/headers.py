"""Header grammars of the three applications as one pattern each, and the entries parsed with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.functions.identifiers import identifiers
from voxledger.functions.steps import Steps, once, take
from voxledger.functions.temporal import utc_steps

#: The levels each application writes.
VPL_LEVELS = ("DEBUG", "INFO", "NOTICE", "WARNING", "ERR", "CRIT", "ALERT")
ORK_LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")
VOCI_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")

#: Header patterns. Tokens are parted by blanks or tabs on the header's own line.
_UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
_VPL_LEVEL = "|".join(VPL_LEVELS)
VPL_REAL = rf"^(?:({_UUID})[ \t]+)?(\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}\.\d{{1,6}})[ \t]+(\d+(?:\.\d+)?%)[ \t]+\[({_VPL_LEVEL})\][ \t]+(\S+)[ \t]+(?=[^\r\n])((?s:.*\S.*))$"
VPL_LEGACY = rf"^(\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}})[ \t]+\[({_VPL_LEVEL})\][ \t]+(\S+)[ \t]+(?=[^\r\n])((?s:.*\S.*))$"
VPL_APPARENT = r"^(?:[\p{L}\p{N}]{8}-[\p{L}\p{N}]{4}-[\p{L}\p{N}]{4}-[\p{L}\p{N}]{4}-[\p{L}\p{N}]{12}[ \t]+)?\d{4}-\d{2}-\d{2}(?:\s|$)"
_ORK_LEVEL = "(?i:" + "|".join(ORK_LEVELS) + ")"
ORK_REAL = rf"^(\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d{{1,6}})?(?:Z|[+-]\d{{2}}:\d{{2}}))[ \t]+(\S+)[ \t]+([^\s\[\]:]+)\[([0-9]+)\]:[ \t]+({_ORK_LEVEL}) - ((?:(?! - )[^\r\n\t])*[^\s]) - ((?s:.*\S.*))$"
ORK_LEGACY = rf"^\s*((?:(?! \| )[^\r\n])*\S)\s* \| \s*({_ORK_LEVEL})\s* \| \s*((?s:.*\S))\s*$"
ORK_APPARENT = r"^\d{4}-\d{2}-\d{2}T"

#: The kinds of a line.
VALID, APPARENT, CONTINUATION = "CABECALHO_VALIDO", "CABECALHO_APARENTE_INVALIDO", "CONTINUACAO"
#: Failure codes of blocks that don't parse.
ORPHAN, INVALID_HEADER, INVALID_UTF8 = "CONTINUACAO_ORFA", "CABECALHO_APARENTE_INVALIDO", "INVALID_UTF8"


#: What leads the groups of a match: no header begins with it.
_MATCHED = "\u0000\n"


def _real_time(text: Column) -> Column:
    return F.try_to_timestamp(text).isNotNull()


def _matched(text: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern that matches a whole text, from one run of it, behind a mark; else the text. They are told
    apart by line feeds, which no group of a header but the last, its message, can hold."""
    return F.regexp_replace(text, pattern, _MATCHED + "\n".join(f"${i + 1}" for i in range(n)))


def _groups(text: Column, found: Column, n: int) -> Column:
    """The groups that _matched() found; null if the pattern doesn't match."""
    return F.when(found.startswith(_MATCHED) & ~text.startswith(_MATCHED), F.split(F.substring(found, len(_MATCHED) + 1, 2**31 - 1), "\n", n))


#: The patterns of the real and the legacy grammar of each application, and how many groups they have.
_REAL = (("VPL", VPL_REAL, 6), ("ORK", ORK_REAL, 7))
_LEGACY = (("VPL", VPL_LEGACY, 4), ("ORK", ORK_LEGACY, 3))


def _by_app(app: Column, grammars: tuple, make: Callable[[str, int], Column]) -> Column:
    (first, pattern, n), *rest = grammars
    out = F.when(app == first, make(pattern, n))
    for name, pattern, n in rest:
        out = out.when(app == name, make(pattern, n))
    return out


def _valid_real(app: Column, g: Column) -> Column:
    """Do the groups of the real grammar hold a real time and, in the orchestrator's, a logger without blanks around it?"""
    stamp = F.nullif(F.when(app == "VPL", F.get(g, F.lit(1))).otherwise(F.get(g, F.lit(0))), F.lit(""))
    return g.isNotNull() & ((app != "ORK") | (F.trim(F.get(g, F.lit(5))) == F.get(g, F.lit(5)))) & _real_time(stamp)


def _valid_legacy(g: Column) -> Column:
    return _real_time(F.nullif(F.get(g, F.lit(0)), F.lit("")))


def _header_steps(app: Column, text: Column) -> Steps:
    """`__real` and `__old`: the groups of the real grammar, else of the legacy one, where the header is valid.
    Each is a column of its own, so that a pattern is run once for a text, however often its groups are used."""
    found, g, o = F.col("__found"), F.col("__real"), F.col("__old")
    return [
        {"__found": _by_app(app, _REAL, lambda pattern, n: _matched(text, pattern, n))}, {"__real": _by_app(app, _REAL, lambda _, n: _groups(text, found, n))}, {"__real": F.when(_valid_real(app, g), g)},
        {"__found": F.when(g.isNull(), _by_app(app, _LEGACY, lambda pattern, n: _matched(text, pattern, n)))}, {"__old": _by_app(app, _LEGACY, lambda _, n: _groups(text, found, n))}, {"__old": F.when(_valid_legacy(o), o)},
    ]


def _kind(text: Column, apparent: Column, valid: Column) -> Column:
    """Whether a line that seems a header is a valid one isn't asked where only continuations are told from the rest."""
    return F.when(text.isNull(), CONTINUATION).when(apparent, F.when(valid, VALID).otherwise(APPARENT)).when(valid, VALID).otherwise(CONTINUATION)


def start_kind(app: Column, text: Column) -> Column:
    """Valid header, header that only looks like one, or continuation; undecodable lines continue."""
    real, old = (_by_app(app, grammars, lambda pattern, n: _groups(text, _matched(text, pattern, n), n)) for grammars in (_REAL, _LEGACY))
    return _kind(text, apparent_header(app, text), _valid_real(app, real) | _valid_legacy(old))


@once
def _kind_steps() -> Steps:
    app, t = F.col("app"), F.col("text")
    tried = F.when(F.col("__apparent") | (app == "ORK") & F.contains(t, F.lit("|")), t)
    kind = _kind(t, F.col("__apparent"), F.col("__real").isNotNull() | F.col("__old").isNotNull())
    return [{"__apparent": apparent_header(app, t)}, {"__tried": tried}, *_header_steps(app, F.col("__tried")), {"start_kind": kind}]


def with_start_kind(lines: DataFrame) -> DataFrame:
    """lines (app, text) with their start_kind(). Of lines that don't seem headers only the orchestrator's legacy ones, which
    have a bar, can be valid: the grammars aren't tried on others."""
    return take(lines, _kind_steps()).drop("__apparent", "__tried", "__found", "__real", "__old")


def apparent_header(app: Column, text: Column) -> Column:
    return F.when(app == "VPL", text.rlike(VPL_APPARENT)).when(app == "ORK", text.rlike(ORK_APPARENT)).otherwise(False)


@once
def _entry_steps() -> tuple[Steps, list[Column]]:
    """The steps from blocks to entries, and what is told of these."""
    t, app, real, old = F.col("text"), F.col("app"), F.col("__real"), F.col("__old")
    fmt = F.when(real.isNotNull(), F.concat(F.lower(app), F.lit("-real"))).when(old.isNotNull(), F.concat(F.lower(app), F.lit("-legado")))
    f = F.col("format")

    def pick(vpl_real, vpl_old, ork_real, ork_old):
        out = F.lit(None).cast("string")
        for form, groups, g in (("vpl-real", real, vpl_real), ("vpl-legado", old, vpl_old), ("ork-real", real, ork_real), ("ork-legado", old, ork_old)):
            out = out if g is None else F.when(f == form, F.nullif(F.get(groups, F.lit(g - 1)), F.lit(""))).otherwise(out)
        return out

    parts = {
        "ChannelUuid": pick(1, None, None, None), "timestamp": pick(2, 1, 1, 1), "percentual_operacional": pick(3, None, None, None), "host": pick(None, None, 2, None),
        "processo": pick(None, None, 3, None), "pid": pick(None, None, 4, None), "severidade": pick(4, 2, 5, 2), "origem": pick(5, 3, None, None), "logger": pick(None, None, 6, None), "mensagem": pick(6, 4, 7, 3),
    }
    steps = [*_header_steps(app, t), {"format": fmt}, {"__p": F.struct(*[c.alias(n) for n, c in parts.items()])}]
    parts = {n: F.col(f"__p.{n}") for n in parts}
    fields = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in parts.items()]), lambda x: x["value"].isNotNull())
    region = F.when(f == "ork-real", F.length(t) - F.length(parts["logger"]) - 3 - F.length(parts["mensagem"])).when(f == "ork-legado", F.length(F.regexp_replace(t, r"\s+\z", "")) - F.length(parts["mensagem"])).when(f.isNotNull(), F.length(t) - F.length(F.ltrim(parts["mensagem"])))
    steps += [*utc_steps(parts["timestamp"], app == "VPL", "__time"), {"fields": fields, "identifiers": identifiers(app, F.when(f.isNotNull(), t), region, parts["ChannelUuid"])}]
    value = parts.__getitem__
    broken = F.when(t.isNull(), INVALID_UTF8).when(f.isNull(), F.concat(app, F.lit("_"), F.when(F.col("start_kind") == "CONTINUACAO", ORPHAN).otherwise(INVALID_HEADER)))
    failures = F.array_compact(F.array(broken, F.when(f.isNotNull(), F.col("__time.failure"))))
    return steps, [
        f, f.isNotNull().alias("interpreted"), F.upper(value("severidade")).alias("level"), value("mensagem").alias("message"), F.coalesce(value("origem"), value("logger")).alias("origin"),
        value("timestamp").alias("timestamp_original"), F.when(f.isNotNull(), F.col("__time.utc")).alias("timestamp_utc"), F.when(f.isNotNull(), F.col("__time.precision")).alias("precision"), F.col("fields"), F.col("identifiers"), failures.alias("failures"),
    ]


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """Entries of VPL and ORK blocks: the real grammar first, then the legacy one, else not interpreted.

    Adds format, interpreted, level, message, origin, timestamp_original, timestamp_utc, precision,
    fields (name, value), identifiers (with spans and lines) and failures (codes).
    """
    steps, told = _entry_steps()
    return take(blocks, steps).select(*blocks.columns, *told)


def parse_voci(lines: DataFrame) -> DataFrame:
    """VOCI lines: time, level and message parted by tabs; other lines are kept, not interpreted."""
    p = F.split("text", "\t", 3)
    stamp, level, message = F.get(p, F.lit(0)), F.upper(F.trim(F.get(p, F.lit(1)))), F.trim(F.get(p, F.lit(2)))
    ok = F.coalesce((F.size(p) == 3) & level.isin(*VOCI_LEVELS) & (message != "") & F.trim(stamp).rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$") & _real_time(F.trim(stamp)), F.lit(False))
    return lines.select("*", ok.alias("interpreted"), F.when(ok, F.trim(stamp)).alias("timestamp_original"), F.when(ok, level).alias("level"), F.when(ok, message).alias("message"))


def print_voci(entries: DataFrame) -> Column:
    """The line an interpreted VOCI entry came from."""
    return F.concat_ws("\t", "timestamp_original", "level", "message")


def print_entry() -> Column:
    """The header line an interpreted VPL or ORK entry came from, by its format."""
    v = lambda n: F.get(F.transform(F.filter("fields", lambda x: x["name"] == n), lambda x: x["value"]), F.lit(0))
    f = F.col("format")
    vpl = F.concat_ws(" ", v("ChannelUuid"), v("timestamp"), v("percentual_operacional"), F.concat(F.lit("["), v("severidade"), F.lit("]")), v("origem"), v("mensagem"))
    ork = F.concat_ws(" - ", F.concat(v("timestamp"), F.lit(" "), v("host"), F.lit(" "), v("processo"), F.lit("["), v("pid"), F.lit("]: "), v("severidade")), v("logger"), v("mensagem"))
    return F.when(f.startswith("vpl"), vpl).when(f == "ork-real", ork).when(f == "ork-legado", F.concat_ws(" | ", v("timestamp"), v("severidade"), v("mensagem")))
