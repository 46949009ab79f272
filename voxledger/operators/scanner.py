"""The final scan of sanitised texts: what may still be sensitive, by tests of tokens and JVM expressions alone.

It shares no code and no pattern with the detectors that do the replacing, so a fault of theirs isn't repeated here: a
line is cut into tokens, and each kind of value has a test of what its tokens are made of. Placeholders are masked
first. A value after a label must be neutral or a placeholder of one of the label's types. Each finding has the line
that it is in, counted from 1, and a code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The labels whose values must be placeholders, with the types of these.
CONTEXTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "CREDENCIAL": (
        ("CREDENCIAL",),
        ("access token", "api key", "authorization", "client secret", "credencial", "credential", "passwd", "password", "pwd", "refresh token", "secret", "senha", "token"),
    ),
    "CALL_ID": (("CALL_ID",), ("call id", "id chamada", "telecom call id")),
    "UUID": (("UUID", "UUID_CANAL", "UUID_SESSAO"), ("channel uuid", "session uuid", "uuid", "uuid canal", "uuid sessao")),
    "DOCUMENTO": (("DOCUMENTO",), ("cnpj", "cpf", "doc", "document", "documento")),
    "TELEFONE": (("TELEFONE",), ("celular", "fone", "mobile", "msisdn", "phone", "tel", "telefone")),
    "IP": (("IP",), ("endereco ip", "ip", "ip address")),
    "URL_INTERNA": (("URL_INTERNA",), ("endpoint", "internal url", "uri", "url", "url interna")),
    "HOST_INTERNO": (("HOST_INTERNO", "IP"), ("host", "host interno", "hostname", "servidor")),
    "DADO_CLIENTE": (
        ("DADO_CLIENTE",),
        ("client data", "cliente", "conteudo cliente", "customer", "customer data", "dado cliente", "email", "email cliente", "nome cliente"),
    ),
}
#: Values that say nothing; types of placeholders; suffixes of internal hosts; schemes.
NEUTRAL = ("", "-", "n/a", "na", "none", "null", "undefined", "[redacted]", "redacted")
TYPES = ("CALL_ID", "UUID_CANAL", "UUID_SESSAO", "UUID", "TELEFONE", "DOCUMENTO", "IP", "HOST_INTERNO", "URL_INTERNA", "CREDENCIAL", "DADO_CLIENTE")
PLACEHOLDER = rf"<(?:{'|'.join(TYPES)})_[1-9][0-9]*>"
SUFFIXES = ("corp", "internal", "intranet", "invalid", "lan", "local", "private", "test")
WEB, SIP, AUTH = ("http", "https", "ws", "wss"), ("sip", "sips"), ("basic", "bearer")
OPAQUE = ("syn_call_", "syn_call-", "callid_", "callid-", "call_", "call-")
#: Sources that no text may refer to, and what a copy of the first is called.
FORBIDDEN_LOGS = ("backup", "bruto", "bruta", "copy", "export", "fixture", "raw", "sample")
FORBIDDEN_REPORTS = ("rawreport", "rawreports", "reportraw", "reportsraw", "relatoriobruto", "relatoriosbrutos", "relatóriobruto", "relatóriosbrutos", "relatoriobrutos", "relatoriosbruto", "relatóriobrutos", "relatóriosbruto")
#: Codes that are told but are no leak by themselves.
INFORMATIVE = ("URL",)
#: What stands for a masked placeholder: no test takes it for part of a value.
_MASK = "␀"
LOWER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
_BLANK = r"\s\x1c-\x1f\x85\xa0  -     　"

Test = Callable[[Column], Column]


def _only(token: Column, allowed: str) -> Column:
    """Is a token made of these characters alone, and of some?"""
    return (token != "") & (F.translate(token, allowed, "") == "")


def _cut(line: Column, at: str) -> Column:
    return F.split(line, f"[{at}]+")


def _words(line: Column) -> Column:
    return _cut(line, _BLANK + r"\"'<>(){}\[\],;=|" + _MASK)


def _bare_end(token: Column) -> Column:
    return F.rtrim(token, F.lit(".!?:"))


def _hits(tokens: Column, test: Test) -> Column:
    return F.size(F.filter(tokens, test))


def _all(parts: Column, test: Test) -> Column:
    return F.forall(parts, test)


def _private(host: Column) -> Column:
    """Is a host an address of a private net?"""
    p = F.split(host, r"\.")
    n = lambda i: F.get(p, F.lit(i)).try_cast("int")
    inside = n(0).isin(10, 127) | ((n(0) == 192) & (n(1) == 168)) | ((n(0) == 169) & (n(1) == 254)) | ((n(0) == 172) & n(1).between(16, 31))
    return F.coalesce((F.size(p) == 4) & _only(host, DIGITS + ".") & inside, F.lit(False))


def _named_inside(host: Column) -> Column:
    """Is a host's name that of an internal one: localhost, or some label before an internal suffix?"""
    labels = F.split(F.rtrim(host, F.lit(".")), r"\.")
    last, n = F.element_at(labels, -1), F.size(labels)
    arpa = F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)) == F.array(F.lit("home"), F.lit("arpa"))
    inside = (n >= 2) & last.isin(*SUFFIXES) | (n >= 3) & arpa
    return (host == "localhost") | inside & _all(labels, lambda x: _only(x, LOWER + DIGITS + "-"))


def internal_host(host: Column) -> Column:
    """Is a host internal: by its name, without a dot, or at a private address?"""
    low = F.lower(host)
    return _named_inside(low) | ~F.contains(low, F.lit(".")) | _private(low)


# ---------------------------------------------------------------- tests of a line, in lower case where it says low


def _urls(line: Column, schemes: tuple[str, ...]) -> Column:
    """What stands after '://' of words whose scheme is one of these."""
    cut = lambda w: F.split(w, "://", 2)
    scheme = lambda w: F.element_at(F.split(F.get(cut(w), F.lit(0)), "[^a-z]"), -1)
    kept = F.filter(_cut(F.lower(line), _BLANK + "\"'<>"), lambda w: F.contains(w, F.lit("://")) & scheme(w).isin(*schemes) & (F.get(cut(w), F.lit(1)) != ""))
    return F.transform(kept, lambda w: F.get(cut(w), F.lit(1)))


def _host_of(rest: Column) -> Column:
    """The host of what stands after '://'."""
    place = F.element_at(F.split(F.get(F.split(rest, "[/?#]", 2), F.lit(0)), "@"), -1)
    return F.get(F.split(place, ":", 2), F.lit(0))


def _url(line: Column) -> Column:
    return F.size(_urls(line, WEB + SIP))


def _internal_url(line: Column) -> Column:
    return _hits(_urls(line, WEB), lambda u: (_host_of(u) != "") & ~F.contains(_host_of(u), F.lit(_MASK)) & internal_host(_host_of(u)))


def _private_key(line: Column) -> Column:
    return (F.contains(line, F.lit("-----BEGIN ")) & F.contains(line, F.lit("PRIVATE KEY-----"))).cast("int")


def _scheme(line: Column) -> Column:
    w = F.filter(_cut(line, _BLANK + "=:\"',;"), lambda x: x != "")
    after = F.transform(w, lambda x, i: F.when(F.lower(x).isin(*AUTH), F.get(w, i + 1)))
    return _hits(after, lambda x: F.coalesce((F.length(x) >= 8) & _only(F.substring(F.lower(x), 1, 8), LOWER + DIGITS + "._~+/-"), F.lit(False)))


def _jwt(line: Column) -> Column:
    """Three parts of base64 between dots, the first of which begins as an object does."""
    def test(w: Column) -> Column:
        parts = F.split(_bare_end(w), r"\.")
        return w.startswith("eyJ") & (F.size(parts) == 3) & _all(parts, lambda p: (F.length(p) >= 8) & _only(F.lower(p), LOWER + DIGITS + "_-"))

    return _hits(_cut(line, "^A-Za-z0-9_.-"), test)


def _access_key(line: Column) -> Column:
    return _hits(_cut(line, "^A-Z0-9"), lambda w: w.startswith("AKIA") & (F.length(w) == 20))


def _uuid(line: Column) -> Column:
    """Hexadecimal groups of 8, 4, 4, 4 and 12."""
    sizes = lambda w: F.concat(F.lit(","), F.array_join(F.transform(F.split(w, "-"), lambda p: F.length(p).cast("string")), ","), F.lit(","))
    return _hits(_cut(F.lower(line), "^0-9a-f-"), lambda w: F.contains(sizes(w), F.lit(",8,4,4,4,12,")))


def _groups(w: Column, at: str) -> Column:
    return F.concat(F.lit(","), F.array_join(F.transform(F.split(w, at), lambda p: F.length(p).cast("string")), ","), F.lit(","))


def _document(line: Column) -> Column:
    """Digits in groups of 3, 3, 3 and 2, or 2, 3, 3, 4 and 2, between the marks of the two kinds of document."""
    marks = lambda w: F.translate(w, DIGITS, "")
    person = lambda w: F.contains(_groups(w, "[.-]"), F.lit(",3,3,3,2,")) & F.contains(marks(w), F.lit("..-"))
    firm = lambda w: F.contains(_groups(w, "[./-]"), F.lit(",2,3,3,4,2,")) & F.contains(marks(w), F.lit("../-"))
    return _hits(_cut(line, "^0-9./-"), lambda w: person(w) | firm(w))


def _ip(line: Column) -> Column:
    def test(w: Column) -> Column:
        parts = F.split(F.rtrim(w, F.lit(".")), r"\.")
        return (F.size(parts) == 4) & _all(parts, lambda p: (F.length(p).between(1, 3)) & F.coalesce(p.try_cast("int") <= 255, F.lit(False)))

    return _hits(_cut(line, "^0-9."), test)


def _ipv6(line: Column) -> Column:
    def test(w: Column) -> Column:
        parts = F.split(w, ":")
        n = F.size(parts)
        short = F.contains(w, F.lit("::")) & (n <= 9) & ~w.endswith("::")
        return _only(w, HEX + ":") & (F.translate(w, ":", "") != "") & _all(parts, lambda p: F.length(p) <= 4) & ((n == 8) & _all(parts, lambda p: p != "") | short)

    return _hits(_cut(F.lower(line), "^0-9a-z:_"), test)


def _phone_sizes() -> list[str]:
    """Sizes of the groups of a number of 10 to 15 digits that ends in four: perhaps a country, an area, the number."""
    out = []
    for area in ("2,", "3,", ""):
        for mid in ("3", "4", "5"):
            for country in ("", "1,", "2,", "3,"):
                sizes = country + area + mid + ",4"
                if 10 <= sum(map(int, sizes.split(","))) <= 15:
                    out.append(f",{sizes},")
    return out


def _phone(line: Column) -> Column:
    grouped = lambda w: F.exists(F.array(*[F.lit(s) for s in _phone_sizes()]), lambda s: F.contains(_groups(w, "[ .()-]{1,2}"), s))
    whole = lambda w: F.startswith(w, F.lit("+")) & F.length(F.translate(w, "+ .-", "")).between(10, 15) & _only(F.substring(w, 2, 20), DIGITS)
    chunks = F.transform(F.filter(F.split(line, "[^0-9A-Za-z+() .-]+"), lambda x: F.translate(x, DIGITS, "") != x), lambda x: F.split(x, "[A-Za-z]\\S*|\\S*[A-Za-z]"))
    return _hits(F.flatten(chunks), lambda w: grouped(F.translate(w, "+", "")) | whole(F.trim(w)))


def _host(line: Column) -> Column:
    return _hits(_cut(F.lower(line), "^a-z0-9._-"), lambda w: ~F.contains(w, F.lit("_")) & _named_inside(F.rtrim(w, F.lit("."))))


def _email(line: Column) -> Column:
    def test(w: Column) -> Column:
        sides = F.split(w, "@")
        domain = F.transform(F.split(F.get(F.split(F.get(sides, F.lit(1)), "[^a-z0-9.-]", 2), F.lit(0)), r"\."), lambda x: x)
        before = F.element_at(F.split(F.get(sides, F.lit(0)), "[^a-z0-9.!#$%&*+/=?^_`{|}~'-]"), -1)
        return (F.size(sides) >= 2) & (before != "") & (F.size(domain) >= 2) & (F.get(domain, F.lit(0)) != "") & (F.get(domain, F.lit(1)) != "")

    return _hits(F.filter(_cut(F.lower(line), _BLANK + "\"<>(){},;:" + _MASK), lambda w: F.contains(w, F.lit("@"))), test)


def _opaque(line: Column) -> Column:
    """A known beginning and four characters or more, of which the first is a letter or digit."""
    def test(w: Column) -> Column:
        out = F.lit(False)
        for p in OPAQUE:
            rest = F.substring(w, len(p) + 1, 99)
            out = out | w.startswith(p) & (F.length(rest) >= 4) & _only(F.substring(rest, 1, 1), LOWER + DIGITS)
        return out

    tails = lambda w: F.concat(F.array(w), F.split(w, r"\."))
    return _hits(_cut(F.lower(line), "^a-z0-9._-"), lambda w: F.exists(tails(w), test))


def _sip_user(line: Column) -> Column:
    def user(w: Column) -> Column:
        sip = F.element_at(F.split(w, "sips?:"), -1)
        channel = F.get(F.split(F.element_at(F.split(w, "sofia/"), -1), "/", 2), F.lit(1))
        return F.get(F.split(F.when(F.contains(w, F.lit("sofia/")), channel).otherwise(sip), "@", 2), F.lit(0))

    named = F.filter(_cut(F.lower(line), _BLANK + ";>"), lambda w: F.contains(w, F.lit("@")) & (w.rlike("(?:^|[^a-z0-9_])sips?:") | F.contains(w, F.lit("sofia/"))))
    return _hits(named, lambda w: F.coalesce((user(w) != "") & ~F.contains(user(w), F.lit(_MASK)), F.lit(False)))


def _log_source(line: Column) -> Column:
    """'logs' as a word of its own, before a slash or the name of a copy."""
    parts = F.split(F.lower(line), "logs")
    alone = lambda i: ~F.coalesce(F.right(F.get(parts, i - 1), F.lit(1)).rlike("[a-z0-9]"), F.lit(False))
    named = lambda x: F.regexp_extract(x, "^[._-]([a-z]+)", 1)
    copy = lambda x: F.rtrim(named(x), F.lit("s")).isin(*FORBIDDEN_LOGS)
    hit = F.transform(parts, lambda x, i: (i > 0) & alone(i) & (F.left(x, F.lit(1)).isin("/", "\\") | copy(x)))
    return _hits(hit, lambda x: x)


def _curation(line: Column) -> Column:
    return _hits(_cut(F.lower(line), "^a-z0-9_."), lambda w: (_bare_end(w) == "curation.db") | F.endswith(_bare_end(w), F.lit(".curation.db")))


def _dashboard(line: Column) -> Column:
    return _hits(_cut(F.lower(line), "^a-z0-9"), lambda w: w == "dashboard")


def _raw_report(line: Column) -> Column:
    w = F.filter(F.split(F.lower(line), r"[^\p{L}]+"), lambda x: x != "")
    pairs = F.transform(w, lambda x, i: F.concat(x, F.coalesce(F.get(w, i + 1), F.lit(""))))
    return _hits(F.concat(w, pairs), lambda x: x.isin(*FORBIDDEN_REPORTS))


def _has(*needles: str) -> Test:
    def test(line: Column) -> Column:
        out = F.lit(False)
        for n in needles:
            out = out | F.contains(line, F.lit(n))
        return out

    return test


_low = lambda *needles: lambda line: _has(*needles)(F.lower(line))
#: The codes. Each has a sign without which its test finds nothing, and the test: how many findings.
CODES: dict[str, tuple[Test, Test]] = {
    "URL": (_has("://"), _url), "URL_INTERNA": (_has("://"), _internal_url), "CHAVE_PRIVADA": (_has("PRIVATE KEY"), _private_key), "ESQUEMA": (_low(*AUTH), _scheme), "JWT": (_has("eyJ"), _jwt), "CHAVE_ACESSO": (_has("AKIA"), _access_key),
    "UUID": (lambda x: x.rlike("(?i)[0-9a-f]{8}-[0-9a-f]{4}-"), _uuid), "DOCUMENTO": (lambda x: x.rlike("[0-9]-[0-9]{2}"), _document), "IP": (lambda x: x.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]"), _ip), "IPV6": (lambda x: x.rlike("(?i):[0-9a-f]{0,4}:"), _ipv6),
    "TELEFONE": (lambda x: x.rlike(r"[0-9][ .-][0-9]{4}|\+[0-9]"), _phone), "HOST_INTERNO": (_low("localhost", ".home.arpa", *(f".{s}" for s in SUFFIXES)), _host), "EMAIL": (_has("@"), _email), "CALL_ID_OPACO": (_low("call_", "call-", "callid_", "callid-"), _opaque),
    "USUARIO_SIP": (_has("@"), _sip_user), "FONTE_PROIBIDA_LOGS": (_low("logs"), _log_source), "FONTE_PROIBIDA_CURATION_DB": (_low("curation.db"), _curation), "FONTE_PROIBIDA_DASHBOARD": (_low("dashboard"), _dashboard), "FONTE_PROIBIDA_RELATORIO_BRUTO": (_low("raw", "brut"), _raw_report),
}


#: What a label's end looks like: labels end in a letter, and '=' or ':' follows, perhaps after a quote and blanks.
_LABEL_END = rf"[A-Za-z_-][\"']?[{_BLANK}]*[=:]"
#: The signs of all codes and of labels in one pattern, for texts in lower case. It may let more through, never less. What
#: its words begin with is asked first.
_ANY_SIGN = (
    r"[=:@]|(?=[+0-9a-f.lpr])(?:\+[0-9]|[0-9][ .-][0-9]|[0-9a-f]{8}-|private key|eyj|akia|b(?:asic|earer|rut)|l(?:ocalhost|ogs)|raw|dashboard|c(?:all(?:id)?[_-]|uration\.db)|\.(?:home\.arpa|"
    + "|".join(SUFFIXES) + "))"
)


# ---------------------------------------------------------------- values after labels


def _joined(words: Column, n: int) -> Column:
    """The last n words as one, without what parts words of a label."""
    size = F.size(words)
    tail = F.slice(words, F.greatest(size - (n - 1), F.lit(1)), F.lit(n))
    return F.when(size >= n, F.translate(F.array_join(tail, ""), "_-", ""))


def _value(piece: Column) -> Column:
    """The value that a piece of a line begins with: in quotes, in angle brackets, or up to a delimiter."""
    start = F.regexp_replace(piece, f"^[{_BLANK}]+", "")
    mark = F.left(start, F.lit(1))
    close = F.when(mark == "<", ">").otherwise(mark)
    inside = F.get(F.split(F.substring(start, 2, 1 << 30), F.concat(F.lit("["), close, F.lit("]")), 2), F.lit(0))
    plain = F.get(F.split(start, rf"[{_BLANK},;}}\]]", 2), F.lit(0))
    return F.when(mark.isin("'", '"'), inside).when(mark == "<", F.concat(F.lit("<"), inside, F.lit(">"))).otherwise(plain)


def _labelled(line: Column) -> Column:
    """Codes of labels whose values are neither neutral nor placeholders of an accepted type."""
    pieces = F.split(line, "[=:]")
    known = {"".join(n.split(" ")): code for code, (_, names) in CONTEXTS.items() for n in names}
    code_of = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    accepted = F.create_map(*[x for code, (types, _) in CONTEXTS.items() for x in (F.lit(code), F.array(*[F.lit(t) for t in types]))])

    def code(piece: Column) -> Column:
        words = F.filter(F.split(F.lower(piece), r"[^a-z0-9_-]+"), lambda w: w != "")
        ends = piece.rlike(rf"[A-Za-z0-9_-][\"']?[{_BLANK}]*$")
        return F.when(ends, F.coalesce(code_of[_joined(words, 1)], code_of[_joined(words, 2)], code_of[_joined(words, 3)]))

    def unsafe(found: Column, value: Column) -> Column:
        bare = F.ltrim(F.rtrim(value, F.lit("\"']")), F.lit("\"'["))
        kind = F.regexp_extract(value, "^<([A-Z_]+)_[1-9][0-9]*>$", 1)
        return found.isNotNull() & ~F.lower(bare).isin(*NEUTRAL) & ~F.lower(value).isin(*NEUTRAL) & ~F.array_contains(accepted[found], kind)

    told = F.transform(pieces, lambda p, i: F.struct(code(p).alias("code"), _value(F.coalesce(F.get(pieces, i + 1), F.lit(""))).alias("value")))
    return F.transform(F.filter(told, lambda x: unsafe(x["code"], x["value"])), lambda x: F.concat(F.lit("ROTULO_"), x["code"]))


# ---------------------------------------------------------------- findings


def places(text: Column) -> Column:
    """array of (line, code) of all findings of a text; null has none.

    Lines without any sign aren't tested further; placeholders are masked once for a text."""
    none = F.array().cast("array<string>")

    def of(line: Column, masked: Column) -> Column:
        each = [F.when(sign(masked), F.array_repeat(F.lit(code), test(masked))).otherwise(none) for code, (sign, test) in CODES.items()]
        return F.concat(*each, F.when(line.rlike(_LABEL_END), _labelled(line)).otherwise(none))

    whole = F.coalesce(text, F.lit(""))
    # a placeholder has no line feed, so that masking a text masks its lines
    lines, hidden = F.split(whole, "\n", -1), F.split(F.regexp_replace(whole, PLACEHOLDER, _MASK), "\n", -1)
    numbered = F.zip_with(lines, hidden, lambda line, masked: F.struct(line.alias("text"), masked.alias("masked")))
    numbered = F.filter(F.transform(numbered, lambda x, i: F.struct((i + 1).alias("line"), x["text"].alias("text"), x["masked"].alias("masked"))), lambda x: F.lower(x["masked"]).rlike(_ANY_SIGN))
    found = F.transform(numbered, lambda x: F.transform(of(x["text"], x["masked"]), lambda c: F.struct(x["line"].alias("line"), c.alias("code"))))
    return F.flatten(found)


def findings(text: Column) -> Column:
    """How many findings of a text are leaks. A text that is one placeholder has none."""
    leaks = F.size(F.filter(places(text), lambda p: ~p["code"].isin(*INFORMATIVE)))
    return F.when(text.rlike(rf"\A{PLACEHOLDER}\z"), 0).otherwise(leaks).cast("long")
