"""The built-in simple types: one table that both Column expressions and workers read.

Lexical patterns are written in the common part of Java's and Python's syntax and
are matched against the whole value after white space has been normalised.
"""

from __future__ import annotations

from dataclasses import dataclass

XSD = "http://www.w3.org/2001/XMLSchema"
XSI = "http://www.w3.org/2001/XMLSchema-instance"

_NAME0 = "A-Z_a-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�"
_NAME = _NAME0 + "0-9.·̀-ͯ‿-⁀-"
_TZ = r"(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
_YEAR = r"-?(?:[1-9][0-9]{3,}|0[0-9]{3})"
_CLOCK = r"(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|24:00:00(?:\.0+)?)"
_DAY = r"(?:0[1-9]|[12][0-9]|3[01])"
_MONTH = r"(?:0[1-9]|1[0-2])"
_YM, _DT = r"(?:[0-9]+Y)?(?:[0-9]+M)?", r"(?:[0-9]+D)?(?:T(?=[0-9])(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:\.[0-9]+)?S)?)?"


@dataclass(frozen=True)
class Builtin:
    name: str
    base: str | None
    primitive: str
    space: str = "collapse"  # preserve, replace or collapse
    pattern: str | None = None
    low: int | None = None
    high: int | None = None
    item: str | None = None  # of a list type


def _all() -> dict[str, Builtin]:
    out: dict[str, Builtin] = {}

    def add(name: str, base: str | None, primitive: str | None = None, **more) -> None:
        up = out.get(base or "")
        own = {"space": up.space, "pattern": up.pattern, "low": up.low, "high": up.high} if up and base not in ("anySimpleType", "anyAtomicType") else {}
        out[name] = Builtin(name, base, primitive or (up.primitive if up else name), **own | more)

    add("anySimpleType", None, space="preserve")
    add("anyAtomicType", "anySimpleType", "anySimpleType", space="preserve")
    for name, space, pattern in (
        ("string", "preserve", None), ("boolean", "collapse", "true|false|1|0"), ("decimal", "collapse", r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"),
        ("precisionDecimal", "collapse", r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN"),
        ("float", "collapse", r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|-?INF|NaN"), ("double", "collapse", r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|-?INF|NaN"),
        ("duration", "collapse", rf"-?P(?=[0-9T]){_YM}{_DT}"), ("dateTime", "collapse", rf"{_YEAR}-{_MONTH}-{_DAY}T{_CLOCK}{_TZ}"), ("time", "collapse", _CLOCK + _TZ),
        ("date", "collapse", rf"{_YEAR}-{_MONTH}-{_DAY}{_TZ}"), ("gYearMonth", "collapse", rf"{_YEAR}-{_MONTH}{_TZ}"), ("gYear", "collapse", _YEAR + _TZ),
        ("gMonthDay", "collapse", rf"--(?:(?:0[13578]|1[02])-{_DAY}|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|[12][0-9])){_TZ}"),
        ("gDay", "collapse", rf"---{_DAY}{_TZ}"), ("gMonth", "collapse", rf"--{_MONTH}{_TZ}"), ("hexBinary", "collapse", "(?:[0-9a-fA-F]{2})*"),
        ("base64Binary", "collapse", r"(?:(?:[A-Za-z0-9+/] ?){4})*(?:(?:[A-Za-z0-9+/] ?){3}[A-Za-z0-9+/]|(?:[A-Za-z0-9+/] ?){2}[AEIMQUYcgkosw048] ?=|[A-Za-z0-9+/] ?[AQgw] ?= ?=)?"),
        ("anyURI", "collapse", None), ("QName", "collapse", f"(?:[{_NAME0}][{_NAME}]*:)?[{_NAME0}][{_NAME}]*"), ("NOTATION", "collapse", f"(?:[{_NAME0}][{_NAME}]*:)?[{_NAME0}][{_NAME}]*"),
    ):
        add(name, "anyAtomicType", name, space=space, pattern=pattern)
    add("normalizedString", "string", space="replace")
    add("token", "normalizedString", space="collapse")
    add("language", "token", pattern="[A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*")
    add("NMTOKEN", "token", pattern=f"[:{_NAME}]+")
    add("Name", "token", pattern=f"[:{_NAME0}][:{_NAME}]*")
    add("NCName", "Name", pattern=f"[{_NAME0}][{_NAME}]*")
    for name in ("ID", "IDREF", "ENTITY"):
        add(name, "NCName")
    for name, item in (("NMTOKENS", "NMTOKEN"), ("IDREFS", "IDREF"), ("ENTITIES", "ENTITY")):
        add(name, "anySimpleType", "anySimpleType", space="collapse", item=item)
    big = 10**38 - 1
    add("integer", "decimal", pattern="[+-]?[0-9]+", low=-big, high=big)
    add("nonPositiveInteger", "integer", high=0)
    add("negativeInteger", "nonPositiveInteger", high=-1)
    add("nonNegativeInteger", "integer", low=0)
    add("positiveInteger", "nonNegativeInteger", low=1)
    up = "integer"
    for name, bits in (("long", 64), ("int", 32), ("short", 16), ("byte", 8)):
        add(name, up, low=-(2 ** (bits - 1)), high=2 ** (bits - 1) - 1)
        up = name
    up = "nonNegativeInteger"
    for name, bits in (("unsignedLong", 64), ("unsignedInt", 32), ("unsignedShort", 16), ("unsignedByte", 8)):
        add(name, up, high=2**bits - 1)
        up = name
    add("yearMonthDuration", "duration", pattern=rf"-?P(?=[0-9]){_YM}")
    add("dayTimeDuration", "duration", pattern=rf"-?P(?=[0-9T]){_DT}")
    add("dateTimeStamp", "dateTime", pattern=rf"{_YEAR}-{_MONTH}-{_DAY}T{_CLOCK}" + _TZ.removesuffix("?"))
    return out


BUILTINS = _all()
#: Values that one version of XSD has and the other lacks, by primitive: 1.1 adds the first, 1.0 lacks the second.
ADDED_IN_11 = {"float": r"\+INF", "double": r"\+INF"}
MISSING_IN_10 = {k: "-?0000(?![0-9])" for k in ("dateTime", "date", "gYearMonth", "gYear")}
ORDERED = frozenset({"decimal", "precisionDecimal", "float", "double", "duration", "dateTime", "time", "date", "gYear", "gYearMonth", "gMonth", "gDay", "gMonthDay"})
TEMPORAL = frozenset({"dateTime", "time", "date", "gYear", "gYearMonth", "gMonth", "gDay", "gMonthDay"})


def ancestors(name: str) -> list[str]:
    """The type and its bases, up to anySimpleType."""
    out = []
    while name:
        out.append(name)
        name = BUILTINS[name].base
    return out
