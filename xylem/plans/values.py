"""Values of simple types in workers and in the schema compiler: parsing, order, equality, canonical forms and checks.

The rules are those of the Column expressions in ``functions.facets``.  A type is compiled once (``compiled``); what it
says about a lexical form is remembered, as documents repeat their values.
"""

from __future__ import annotations

import base64
import re
import struct
from dataclasses import dataclass
from decimal import Decimal
from functools import lru_cache

import regex

from ..functions.builtins import ADDED_IN_11, BUILTINS, MISSING_IN_10, ORDERED, TEMPORAL
from ..functions.facets import Simple
from ..functions.patterns import translate

ATTO = 10**18
DAY = 86_400 * ATTO
#: Unzoned times lie within this of any zoned reading of them.
SLACK = 14 * 3600 * ATTO


@lru_cache(4096)
def _lexical(name: str, version: str) -> re.Pattern | None:
    b = BUILTINS[name]
    if b.pattern is None:
        return None
    more = f"|{ADDED_IN_11[b.primitive]}" if version == "1.1" and b.primitive in ADDED_IN_11 else ""
    less = f"(?!{MISSING_IN_10[b.primitive]})" if version == "1.0" and b.primitive in MISSING_IN_10 else ""
    return re.compile(rf"{less}(?:{b.pattern}{more})\Z")


@lru_cache(4096)
def _step(patterns: tuple[str, ...]) -> regex.Pattern:
    return regex.compile("(?V1)(?:" + "|".join(translate(p, python=True) for p in patterns) + r")\Z")


def space(v: str, mode: str) -> str:
    if mode == "preserve":
        return v
    v = v.translate({9: " ", 10: " ", 13: " "})
    return v if mode == "replace" else " ".join(x for x in v.split(" ") if x)


# -- values -----------------------------------------------------------------------------------------


def days(year: int, month: int, day: int) -> int:
    """The number of a day in the proleptic Gregorian calendar, of any year; 1970-01-01 is 0."""
    year -= month < 3
    era, of_era = divmod(year, 400)
    return era * 146_097 + of_era * 365 + of_era // 4 - of_era // 100 + (153 * ((month + 9) % 12) + 2) // 5 + day - 719_469


def last_day(year: int, month: int) -> int:
    return days(year + month // 12, month % 12 + 1, 1) - days(year, month, 1)


def civil(number: int) -> tuple[int, int, int]:
    era, of_era = divmod(number + 719_468, 146_097)
    y = (of_era - of_era // 1460 + of_era // 36_524 - of_era // 146_096) // 365
    of_year = of_era - (365 * y + y // 4 - y // 100)
    m = (5 * of_year + 2) // 153
    month = m + 3 if m < 10 else m - 9
    return era * 400 + y + (month < 3), month, of_year - (153 * m + 2) // 5 + 1


@dataclass(frozen=True, slots=True)
class Temporal:
    """A point of one temporal type.  Parts that the type lacks are those of a leap reference year."""

    kind: str
    year: int
    month: int
    day: int
    attos: int  # of the day
    zone: int | None  # minutes

    @property
    def instant(self) -> int:
        return days(self.year, self.month, self.day) * DAY + self.attos - (self.zone or 0) * 60 * ATTO

    def __str__(self) -> str:
        year = ("-" if self.year < 0 else "") + f"{abs(self.year):04d}"
        date = {"gYear": year, "gYearMonth": f"{year}-{self.month:02d}", "gMonth": f"--{self.month:02d}", "gDay": f"---{self.day:02d}", "gMonthDay": f"--{self.month:02d}-{self.day:02d}", "time": ""}.get(self.kind, f"{year}-{self.month:02d}-{self.day:02d}")
        clock = ""
        if self.kind in ("time", "dateTime"):
            seconds, part = divmod(self.attos, ATTO)
            clock = ("T" if date else "") + f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}" + (f".{part:018d}".rstrip("0") if part else "")
        zone = "" if self.zone is None else "Z" if not self.zone else f"{'-' if self.zone < 0 else '+'}{abs(self.zone) // 60:02d}:{abs(self.zone) % 60:02d}"
        return date + clock + zone


_PARTS = {
    "dateTime": r"(-?\d+)-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d+))?", "date": r"(-?\d+)-(\d\d)-(\d\d)()()()()", "time": r"()()()(\d\d):(\d\d):(\d\d)(?:\.(\d+))?", "gYearMonth": r"(-?\d+)-(\d\d)()()()()()",
    "gYear": r"(-?\d+)()()()()()()", "gMonthDay": r"--()(\d\d)-(\d\d)()()()()", "gDay": r"---()()(\d\d)()()()()", "gMonth": r"--()(\d\d)()()()()()",
}
_PARTS = {k: re.compile(p + r"(?:(Z)|([+-])(\d\d):(\d\d))?\Z", re.A) for k, p in _PARTS.items()}


def temporal(v: str, kind: str) -> Temporal | None:
    """Nothing where the day does not exist."""
    y, m, d, h, mi, s, part, utc, sign, zh, zm = _PARTS[kind].match(v).groups()
    zone = 0 if utc else None if sign is None else (int(zh) * 60 + int(zm)) * (-1 if sign == "-" else 1)
    # parts that are missing: of a leap year's longest month
    year, month, day = int(y) if y else 1972, int(m) if m else 12 if kind in ("gDay", "time") else 1, int(d) if d else 31 if kind == "time" else 1
    if day > last_day(year, month):
        return None
    attos = (int(h or 0) * 3600 + int(mi or 0) * 60 + int(s or 0)) * ATTO + int((part or "0")[:18].ljust(18, "0"))
    if attos == DAY:
        attos = 0
        if kind == "dateTime":
            year, month, day = civil(days(year, month, day) + 1)
    return Temporal(kind, year, month, day, attos, zone)


#: The starts by which durations are compared: days from each to the starts of later months differ.
STARTS = ((1696, 9), (1697, 2), (1903, 3), (1903, 7))
_DURATION = re.compile(r"(-)?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d+))?S)?)?\Z", re.A)


@dataclass(frozen=True, slots=True)
class Duration:
    months: int
    attos: int

    def after(self, start: tuple[int, int]) -> int:
        at = start[0] * 12 + start[1] - 1 + self.months
        return days(at // 12, at % 12 + 1, 1) * DAY + self.attos

    def __str__(self) -> str:
        sign = "-" if self.months < 0 or self.attos < 0 else ""
        (years, months), (seconds, part) = divmod(abs(self.months), 12), divmod(abs(self.attos), ATTO)
        date = "".join(f"{n}{u}" for n, u in ((years, "Y"), (months, "M"), (seconds // 86_400, "D")) if n)
        clock = "".join(f"{n}{u}" for n, u in ((seconds // 3600 % 24, "H"), (seconds // 60 % 60, "M")) if n)
        if seconds % 60 or part:
            clock += f"{seconds % 60}" + (f".{part:018d}".rstrip("0") if part else "") + "S"
        return f"{sign}P{date}{'T' * bool(clock)}{clock}" if date or clock else "PT0S"


def duration(v: str) -> Duration:
    sign, y, mo, d, h, mi, s, part = _DURATION.match(v).groups()
    k = -1 if sign else 1
    attos = (int(d or 0) * 86_400 + int(h or 0) * 3600 + int(mi or 0) * 60 + int(s or 0)) * ATTO + int((part or "0")[:18].ljust(18, "0"))
    return Duration(k * (int(y or 0) * 12 + int(mo or 0)), k * attos)


@dataclass(frozen=True, slots=True)
class Precise:
    """A precisionDecimal: digits and scale as written; ``special`` is INF or NaN."""

    negative: bool
    digits: int
    scale: int
    special: str | None = None

    @property
    def number(self) -> Decimal:
        return Decimal(f"{'-' if self.negative else ''}{self.digits}E{-self.scale}") if self.special is None else Decimal({"INF": "-Infinity" if self.negative else "Infinity"}.get(self.special, "NaN"))

    def __str__(self) -> str:
        sign = "-" if self.negative else ""
        if self.special:
            return sign + self.special
        text = str(self.digits)
        if self.scale <= 0:
            return f"{sign}{text}" + (f"E{-self.scale}" if self.scale < 0 else "")
        text = text.rjust(self.scale + 1, "0")
        return f"{sign}{text[: -self.scale]}.{text[-self.scale :]}"


def precise(v: str) -> Precise:
    negative, v = v.startswith("-"), v.lstrip("+-")
    if v in ("INF", "NaN"):
        return Precise(negative, 0, 0, v)
    number, _, power = v.lower().partition("e")
    whole, _, part = number.partition(".")
    return Precise(negative, int(whole + part), len(part) - int(power or 0))


def parse(v: str, name: str) -> object:
    """The value of a normalised lexical form of a built-in type; nothing where a date does not exist."""
    p = BUILTINS[name].primitive
    if p == "decimal":
        return Decimal(v)
    if p in ("float", "double"):
        x = float(v.replace("INF", "inf"))
        if p == "float":
            try:
                x = struct.unpack("f", struct.pack("f", x))[0]
            except OverflowError:
                x = float("inf") if x > 0 else float("-inf")
        return x
    if p == "boolean":
        return v in ("true", "1")
    if p in TEMPORAL:
        return temporal(v, p)
    if p == "duration":
        return duration(v)
    if p == "precisionDecimal":
        return precise(v)
    if p == "hexBinary":
        return bytes.fromhex(v)
    if p == "base64Binary":
        return base64.b64decode(v.replace(" ", ""))
    return v


def order(a: object, b: object) -> int | None:
    """-1, 0 or 1; nothing where two values are not ordered."""
    if isinstance(a, Temporal) and isinstance(b, Temporal) and a.kind == b.kind:
        x, y = a.instant, b.instant
        if (a.zone is None) != (b.zone is None) and abs(x - y) <= SLACK:
            return None
        return (x > y) - (x < y)
    if isinstance(a, Duration) and isinstance(b, Duration):
        found = {(x > y) - (x < y) for x, y in ((a.after(s), b.after(s)) for s in STARTS)}
        return found.pop() if len(found) == 1 else None
    if isinstance(a, Precise) and isinstance(b, Precise):
        a, b = a.number, b.number
    if isinstance(a, Decimal) and isinstance(b, Decimal) and not (a.is_nan() or b.is_nan()) or type(a) is float and type(b) is float and a == a and b == b:
        return (a > b) - (a < b)
    return None


def key(x: object, primitive: str) -> object:
    """Equal for equal values of a primitive type, and hashable; a NaN equals nothing."""
    if isinstance(x, Temporal):
        return primitive, x.instant, x.zone is None
    if isinstance(x, float) and x != x or isinstance(x, Precise) and x.special == "NaN":
        return primitive, object()
    return primitive, x.number if isinstance(x, Precise) else x


def written(x: object, v: str, primitive: str) -> str:
    """The canonical form of the value ``x`` of ``v``."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, Decimal):
        text = format(x.copy_abs(), "f")
        text = text.rstrip("0").rstrip(".") if "." in text else text
        return ("-" if x < 0 else "") + (text or "0")
    if isinstance(x, float):
        return _float(x)
    if isinstance(x, bytes):
        return x.hex().upper() if primitive == "hexBinary" else base64.b64encode(x).decode()
    return v if x is None else str(x)


def _float(x: float) -> str:
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "INF" if x > 0 else "-INF"
    if x == 0:
        return "-0" if str(x).startswith("-") else "0"
    text = repr(x)
    if abs(x) < 3.4e38 and struct.unpack("f", struct.pack("f", x))[0] == x:  # a float: the shortest text that reads as it
        short = next((s for s in (f"{x:.{k}g}" for k in range(1, 10)) if struct.unpack("f", struct.pack("f", float(s)))[0] == x), text)
        text = short if len(short) < len(text) else text
    return format(Decimal(text).normalize(), "f")


# -- types ------------------------------------------------------------------------------------------


class Compiled:
    """A simple type ready to check: ``look(v)`` is (what fails first or nothing, canonical form, key of the value, the type that took it)."""

    MOST = 20_000

    def __init__(self, t: Simple, version: str = "1.0") -> None:
        self.type, self.version = t, version
        self.mode, self.known = t.whitespace, {}
        self.steps = [_step(step) for step in t.patterns]
        self.item = compiled(t.item, version) if t.item else None
        self.members = [compiled(m, version) for m in t.members]
        b = self.builtin = BUILTINS[t.builtin]
        self.lexical = _lexical(t.builtin, version)
        self.each = compiled(Simple(b.item, b.item), version) if b.item and not t.item and not t.members else None
        f = self.facets = t.facets
        self.length, self.least, self.most = (int(f[k]) if k in f else None for k in ("length", "minLength", "maxLength"))
        self.bounds = []
        for k, bad in (("minInclusive", (-1,)), ("minExclusive", (-1, 0)), ("maxInclusive", (1,)), ("maxExclusive", (0, 1))):
            if k in f and not t.item and not t.members and b.primitive in ORDERED:
                lit = space(str(f[k]), "collapse")
                if (p := _lexical(t.builtin, "1.1")) and p.match(lit) or p is None:
                    self.bounds.append((k, bad, parse(lit, t.builtin)))
        self.enumeration = None
        if "enumeration" in f:
            # literals are read as 1.1 has them, by the type without its facets
            plain = compiled(Simple(t.builtin, item=t.item, members=t.members, space=t.space), "1.1")
            self.enumeration = set()
            for x in f["enumeration"]:
                why, _, k, _ = plain.look(str(x))
                self.enumeration.add(k if why is None else ("lexical", str(x)))
        self.zone = {"required": True, "prohibited": False}.get(str(f.get("explicitTimezone")))

    def look(self, v: str) -> tuple[str | None, str, object, Simple]:
        got = self.known.get(v)
        if got is None:
            got = self._look(v)
            if len(v) <= 64:
                if len(self.known) >= self.MOST:
                    self.known.clear()
                self.known[v] = got
        return got

    def _look(self, raw: str) -> tuple[str | None, str, object, Simple]:
        t, f = self.type, self.facets
        v = space(raw, self.mode)
        for step in self.steps:
            if not step.match(v):
                return "pattern", v, None, t
        if self.members:
            took = next((x for x in (m.look(v) for m in self.members) if x[0] is None), None)
            if took is None:
                return "union", v, None, t
            if self.enumeration is not None and took[2] not in self.enumeration:
                return "enumeration", v, None, t
            return None, took[1], took[2], took[3]
        if self.item or self.each:
            items = [(self.item or self.each).look(x) for x in v.split(" ") if x]
            if any(x[0] is not None for x in items) or self.each and not items:
                return "item" if self.item else "value", v, None, t
            size = len(items)
            canon, own = " ".join(x[1] for x in items), tuple(x[2] for x in items)
            k = own[0] if size == 1 else ("list", own)  # a list of one item equals the item
            return self._sized(size) or ("enumeration" if self.enumeration is not None and k not in self.enumeration else None), canon, k, t
        b = self.builtin
        if self.lexical and not self.lexical.match(v):
            return "value", v, None, t
        p = b.primitive
        if p == "duration" and v[-1] in "PT" or p == "decimal" and (b.low is not None or b.high is not None) and not (b.low if b.low is not None else -(10**38)) <= int(v) <= (b.high if b.high is not None else 10**38):
            return "value", v, None, t
        x = parse(v, t.builtin)
        if x is None:
            return "value", v, None, t
        canon, k = written(x, v, p), key(x, p)
        if p not in ("QName", "NOTATION") and (why := self._sized(len(x) if isinstance(x, bytes) else len(v))):
            return why, canon, k, t
        if isinstance(x, Precise) and x.special is None:
            if x.scale < f.get("minScale", x.scale):
                return "minScale", canon, k, t
            if x.scale > f.get("maxScale", x.scale):
                return "maxScale", canon, k, t
        if self.enumeration is not None and k not in self.enumeration:
            return "enumeration", canon, k, t
        if self.zone is not None and isinstance(x, Temporal) and (x.zone is not None) != self.zone:
            return "explicitTimezone", canon, k, t
        for name, bad, bound in self.bounds:
            if order(x, bound) in bad:
                return name, canon, k, t
        if "totalDigits" in f or "fractionDigits" in f:
            total, part = self.digits(x, canon)
            if total > int(f.get("totalDigits", total)):
                return "totalDigits", canon, k, t
            if part > int(f.get("fractionDigits", part)):
                return "fractionDigits", canon, k, t
        return None, canon, k, t

    @staticmethod
    def digits(x: object, canon: str) -> tuple[int, int]:
        if isinstance(x, Precise):
            return (len(str(x.digits)), max(x.scale, 0)) if x.special is None else (0, 0)
        whole, _, part = canon.lstrip("-").partition(".")
        return len(whole.lstrip("0") + part if whole.strip("0") else part or "0"), len(part)

    def _sized(self, size: int) -> str | None:
        if self.length is not None and size != self.length:
            return "length"
        if self.least is not None and size < self.least:
            return "minLength"
        return "maxLength" if self.most is not None and size > self.most else None


_COMPILED: dict[tuple[int, str], Compiled] = {}


def compiled(t: Simple, version: str = "1.0") -> Compiled:
    got = _COMPILED.get((id(t), version))
    if got is None or got.type is not t:
        if len(_COMPILED) > 50_000:
            _COMPILED.clear()
        got = _COMPILED[(id(t), version)] = Compiled(t, version)
    return got


def in_space(v: str, name: str, version: str = "1.0") -> bool:
    """Whether a normalised value is one of a built-in type."""
    return compiled(_plain(name), version).look(v)[0] is None


@lru_cache(256)
def _plain(name: str) -> Simple:
    return Simple(name, name)


def canonical(v: str, t: Simple) -> str:
    return compiled(t).look(v)[1]


def problem(v: str, t: Simple, version: str = "1.0") -> str | None:
    """What fails first, or nothing."""
    return compiled(t, version).look(v)[0]
