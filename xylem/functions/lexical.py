"""Lexical forms as native Column expressions: white space, checks, typed values and canonical forms.

XSD's lexical spaces are narrower than Spark's casts, so a pattern guards each
cast.  A value that is not in its type's space is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .builtins import ADDED_IN_11, BUILTINS, MISSING_IN_10, TEMPORAL


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then(x)`` with ``x`` computed once: expressions that use a part many times would grow with each level."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def whitespace(c: Column, mode: str) -> Column:
    """``preserve``, ``replace`` or ``collapse``; only blank, tab, line feed and carriage return count."""
    if mode == "preserve":
        return c
    plain = F.translate(c, "\t\n\r", "   ")
    # most values need nothing, and one look at them is cheaper than the rewriting
    return plain if mode == "replace" else F.when(c.rlike(r"[\t\n\r]|^ | $|  "), F.btrim(F.regexp_replace(plain, " +", " "), F.lit(" "))).otherwise(c)


def normalized(c: Column, name: str) -> Column:
    return whitespace(c, BUILTINS[name].space)


def days(year: Column, month: Column, day: Column) -> Column:
    """The number of a day in the proleptic Gregorian calendar, of any year; 1970-01-01 is 0.  All are whole numbers."""
    start = F.struct((year - F.when(month < 3, 1).otherwise(0)).cast("long").alias("y"), month.cast("long").alias("m"), day.cast("long").alias("d"))
    era = lambda x: F.floor(x["y"] / 400)
    parts = let(start, lambda x: F.struct(era(x).alias("era"), (x["y"] - era(x) * 400).alias("of"), (F.floor((153 * ((x["m"] + 9) % 12) + 2) / 5) + x["d"]).alias("in")))
    return let(parts, lambda x: (x["era"] * 146_097 + x["of"] * 365 + F.floor(x["of"] / 4) - F.floor(x["of"] / 100) + x["in"] - 719_469).cast("long"))


def _real_day(c: Column) -> Column:
    """Whether the day of a date or dateTime exists; its shape is already checked."""
    year = F.regexp_extract(c, "^-?([0-9]+)-", 1)
    y = F.substring(F.concat(F.lit("0000"), year), -4, 4).try_cast("int")  # leap years repeat every 400 years
    month, day = F.regexp_extract(c, "^-?[0-9]+-([0-9]{2})", 1), F.regexp_extract(c, "^-?[0-9]+-[0-9]{2}-([0-9]{2})", 1).try_cast("int")
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return day <= F.when(month == "02", F.when(leap, 29).otherwise(28)).when(month.isin("04", "06", "09", "11"), 30).otherwise(31)


def pattern(name: str, version: str = "1.0") -> str | None:
    b = BUILTINS[name]
    if b.pattern is None:
        return None
    more = f"|{ADDED_IN_11[b.primitive]}" if version == "1.1" and b.primitive in ADDED_IN_11 else ""
    less = f"(?!{MISSING_IN_10[b.primitive]})" if version == "1.0" and b.primitive in MISSING_IN_10 else ""
    return rf"\A{less}(?:{b.pattern}{more})\z"


def in_bounds(v: Column, name: str) -> Column:
    """Whether an integer in its lexical form is within the type's own bounds."""
    b = BUILTINS[name]
    wide = b.low is None or b.high is None or max(-b.low, b.high) >= 2**63
    n = v.try_cast("decimal(38,0)" if wide else "long")
    low, high = (F.lit(str(x)).cast("decimal(38,0)" if wide else "long") for x in (b.low if b.low is not None else -(10**38) + 1, b.high if b.high is not None else 10**38 - 1))
    return F.coalesce((n >= low) & (n <= high), F.lit(False))


def is_valid(c: Column, name: str, version: str = "1.0", normal: bool = False) -> Column:
    """Whether a value (not null) is in the lexical space of a built-in type; ``normal``: its white space is already normalised."""
    b = BUILTINS[name]
    v = c if normal else normalized(c, name)
    if b.item:
        items = F.split(v, " ")
        return (v != "") & F.forall(items, lambda x: is_valid(x, b.item, version, True))
    shape = pattern(name, version)
    if b.primitive == "base64Binary":  # blanks are single ones by now; what is left repeats by a fixed length, which takes no stack
        v, shape = F.replace(v, F.lit(" "), F.lit("")), r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=|[A-Za-z0-9+/][AQgw]==)?\z"
    ok = v.rlike(shape) if shape else F.lit(True)
    if b.low is not None or b.high is not None:
        ok = F.when(ok, in_bounds(v, name)).otherwise(False)
    if b.primitive in ("date", "dateTime"):
        ok = F.when(ok, _real_day(v)).otherwise(False)
    if b.primitive == "duration":
        ok = ok & ~v.rlike("(?:P|T)$")
    return ok


def spark_type(name: str) -> str:
    b = BUILTINS[name]
    own = {"byte": "byte", "short": "short", "int": "int", "long": "long", "unsignedByte": "short", "unsignedShort": "int", "unsignedInt": "long", "unsignedLong": "decimal(20,0)"}
    if name in own:
        return own[name]
    if b.item:
        return "array<string>"
    if b.low is not None or b.high is not None:
        return "decimal(38,0)"
    return {"boolean": "boolean", "decimal": "decimal(38,18)", "float": "float", "double": "double", "hexBinary": "binary", "base64Binary": "binary"}.get(b.primitive, "string")


def value(c: Column, name: str) -> Column:
    """The typed value, null where the lexical form is not one of the type."""
    v, b, kind = normalized(c, name), BUILTINS[name], spark_type(name)
    if b.item:
        out = F.split(v, " ")
    elif kind == "boolean":
        out = v.isin("true", "1")
    elif kind in ("float", "double"):
        special = {"INF": "Infinity", "-INF": "-Infinity", "NaN": "NaN"}
        out = F.coalesce(*(F.when(v == k, F.lit(x).cast(kind)) for k, x in special.items()), v.try_cast(kind))
    elif b.primitive == "hexBinary":
        out = F.unhex(v)
    elif b.primitive == "base64Binary":
        out = F.unbase64(F.regexp_replace(v, " ", ""))
    elif kind != "string":
        out = v.try_cast(kind)
    else:
        out = v
    return F.when(c.isNotNull() & is_valid(c, name), out)


def canonical(c: Column, name: str) -> Column:
    """The canonical form as text: equal values have equal forms."""
    v, b = normalized(c, name), BUILTINS[name]
    if b.primitive == "boolean":
        out = F.when(v.isin("true", "1"), "true").otherwise("false")
    elif b.primitive == "decimal":
        whole = F.ltrim(F.regexp_extract(v, r"^[+-]?([0-9]*)", 1), F.lit("0"))
        part = F.rtrim(F.regexp_extract(v, r"\.([0-9]*)$", 1), F.lit("0"))
        text = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
        out = F.when(v.startswith("-") & (text != "0"), F.concat(F.lit("-"), text)).otherwise(text)
    elif b.primitive in ("float", "double"):
        out = _plain_float(value(c, name))
    elif b.primitive == "duration":
        out = _written_duration(duration(v, True))
    elif b.primitive == "hexBinary":
        out = F.upper(v)
    elif b.primitive == "base64Binary":
        out = F.regexp_replace(v, " ", "")
    elif b.primitive in TEMPORAL:
        zone = F.regexp_replace(F.regexp_extract(v, "(Z|[+-][0-9]{2}:[0-9]{2})$", 1), r"^[+-]00:00$", "Z")
        head = F.regexp_replace(v, r"(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?$", "")
        if b.primitive in ("dateTime", "time"):
            part = F.rtrim(F.regexp_extract(v, r":[0-9]{2}\.([0-9]{1,18})", 1), F.lit("0"))
            midnight = head.endswith("24:00:00")
            if b.primitive == "dateTime":
                moved = _written_day(days(F.regexp_extract(head, "^(-?[0-9]+)-", 1).try_cast("long"), F.regexp_extract(head, "^-?[0-9]+-([0-9]{2})", 1).try_cast("long"), F.regexp_extract(head, "-([0-9]{2})T", 1).try_cast("long")) + 1)
                head = F.when(midnight, F.concat(moved, F.lit("T00:00:00"))).otherwise(head)
            else:
                head = F.when(midnight, "00:00:00").otherwise(head)
            head = F.concat(head, F.when((part == "") | midnight, "").otherwise(F.concat(F.lit("."), part)))
        out = F.concat(head, zone)
    else:
        out = v
    return F.when(c.isNotNull() & is_valid(c, name), out)


def _written_day(number: Column) -> Column:
    era = lambda n: F.floor(n / 146_097)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    out = let(number + 719_468, lambda n: F.struct(era(n).alias("era"), (n - era(n) * 146_097).alias("of")))
    out = let(out, lambda x: F.struct(x["era"].alias("era"), x["of"].alias("of"), F.floor((x["of"] - F.floor(x["of"] / 1460) + F.floor(x["of"] / 36_524) - F.floor(x["of"] / 146_096)) / 365).alias("y")))
    out = let(out, lambda x: F.struct((x["era"] * 400 + x["y"]).alias("y"), (x["of"] - (365 * x["y"] + F.floor(x["y"] / 4) - F.floor(x["y"] / 100))).alias("of")))
    out = let(out, lambda x: F.struct(x["y"].alias("y"), x["of"].alias("of"), F.floor((5 * x["of"] + 2) / 153).alias("m")))
    out = let(out, lambda x: F.struct((x["y"] + F.when(x["m"] >= 10, 1).otherwise(0)).alias("y"), F.when(x["m"] < 10, x["m"] + 3).otherwise(x["m"] - 9).alias("m"), (x["of"] - F.floor((153 * x["m"] + 2) / 5) + 1).alias("d")))
    year = lambda x: F.concat(F.when(x["y"] < 0, "-").otherwise(""), F.lpad(F.abs(x["y"]).cast("string"), F.greatest(F.length(F.abs(x["y"]).cast("string")), F.lit(4)), F.lit("0")))
    return let(out, lambda x: F.concat(year(x), F.lit("-"), two(x["m"]), F.lit("-"), two(x["d"])))


def _plain_float(x: Column) -> Column:
    """A float without exponent and without a trailing point."""
    text = x.cast("string")
    digits = F.rtrim(F.concat(F.regexp_extract(text, "^-?([0-9])", 1), F.regexp_extract(text, r"^-?[0-9]\.([0-9]+)E", 1)), F.lit("0"))
    parts = F.struct(digits.alias("d"), F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int").alias("e"))
    small = lambda p: F.concat(F.lit("0."), F.repeat(F.lit("0"), -p["e"] - 1), p["d"])
    large = lambda p: F.when(F.length(p["d"]) <= p["e"] + 1, F.rpad(p["d"], p["e"] + 1, F.lit("0"))).otherwise(F.concat(F.substring(p["d"], F.lit(1), p["e"] + 1), F.lit("."), F.substring(p["d"], p["e"] + 2, F.length(p["d"]))))
    spelled = let(parts, lambda p: F.when(p["e"] < 0, small(p)).otherwise(large(p)))
    out = F.when(text.contains("E"), F.concat(F.when(text.startswith("-"), "-").otherwise(""), spelled)).otherwise(F.regexp_replace(text, r"\.0$", ""))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "INF").when(x == float("-inf"), "-INF").otherwise(out)


def _written_duration(d: Column) -> Column:
    unit = lambda n, u: F.when(n > 0, F.concat(n.cast("long").cast("string"), F.lit(u))).otherwise("")
    parts = let(d, lambda x: F.struct(((x["months"] < 0) | (x["seconds"] < 0)).alias("minus"), F.abs(x["months"]).alias("months"), F.floor(F.abs(x["seconds"])).cast("long").alias("whole"),
                                      F.rtrim(F.regexp_extract(F.abs(x["seconds"]).cast("string"), r"\.([0-9]+)$", 1), F.lit("0")).alias("part")))
    second = lambda x: F.when((x["whole"] % 60 > 0) | (x["part"] != ""), F.concat((x["whole"] % 60).cast("string"), F.when(x["part"] != "", F.concat(F.lit("."), x["part"])).otherwise(""), F.lit("S"))).otherwise("")
    clock = lambda x: F.concat(unit(F.floor(x["whole"] / 3600) % 24, "H"), unit(F.floor(x["whole"] / 60) % 60, "M"), second(x))
    date = lambda x: F.concat(unit(F.floor(x["months"] / 12), "Y"), unit(x["months"] % 12, "M"), unit(F.floor(x["whole"] / 86_400), "D"))
    text = let(parts, lambda x: F.struct(x["minus"].alias("minus"), date(x).alias("date"), clock(x).alias("clock")))
    return let(text, lambda x: F.when((x["date"] == "") & (x["clock"] == ""), "PT0S").otherwise(F.concat(F.when(x["minus"], "-").otherwise(""), F.lit("P"), x["date"], F.when(x["clock"] != "", F.concat(F.lit("T"), x["clock"])).otherwise(""))))


def instant(v: Column, primitive: str) -> Column:
    """Seconds since 1970 of a valid, normalised temporal value (parts that its type lacks are those of a leap year)."""
    part = lambda p: F.regexp_extract(v, p, 1)
    long = lambda c, otherwise=0: F.coalesce(c.try_cast("long"), F.lit(otherwise).cast("long"))
    year = long(part("^(-?[0-9]+)")) if primitive in ("dateTime", "date", "gYearMonth", "gYear") else F.lit(1972).cast("long")
    month = {"dateTime": "^-?[0-9]+-([0-9]{2})", "date": "^-?[0-9]+-([0-9]{2})", "gYearMonth": "^-?[0-9]+-([0-9]{2})", "gMonthDay": "^--([0-9]{2})", "gMonth": "^--([0-9]{2})"}.get(primitive)
    day = {"dateTime": "^-?[0-9]+-[0-9]{2}-([0-9]{2})", "date": "^-?[0-9]+-[0-9]{2}-([0-9]{2})", "gMonthDay": "^--[0-9]{2}-([0-9]{2})", "gDay": "^---([0-9]{2})"}.get(primitive)
    number = days(year, long(part(month)) if month else F.lit(12 if primitive in ("gDay", "time") else 1).cast("long"), long(part(day)) if day else F.lit(31 if primitive == "time" else 1).cast("long"))
    exact = "decimal(38,18)"
    out = (number * 86_400).cast(exact)
    if primitive in ("dateTime", "time"):
        clock = F.regexp_extract(v, r"([0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,18})?)[0-9]*(?:Z|[+-][0-9]{2}:[0-9]{2})?$", 1)
        seconds = long(F.substring(clock, 1, 2)) * 3600 + long(F.substring(clock, 4, 2)) * 60
        out = out + (seconds % 86_400 if primitive == "time" else seconds).cast(exact) + F.coalesce(F.substring(clock, 7, 21).try_cast(exact), F.lit(0).cast(exact))
    zone = F.regexp_extract(v, "([+-][0-9]{2}:[0-9]{2})$", 1)
    minutes = (long(F.substring(zone, 2, 2)) * 60 + long(F.substring(zone, 5, 2))) * F.when(zone.startswith("-"), -1).otherwise(1)
    return (out - (minutes * 60).cast(exact)).cast(exact)


def zoned(v: Column) -> Column:
    return v.rlike("(?:Z|[+-][0-9]{2}:[0-9]{2})$")


def duration(c: Column, normal: bool = False) -> Column:
    """months and seconds of a duration, as a struct; null where it is none (``normal``: it is known to be one)."""
    v = c if normal else normalized(c, "duration")
    exact = "decimal(38,18)"
    part = lambda p: F.coalesce(F.regexp_extract(v, p, 1).try_cast("long"), F.lit(0).cast("long"))
    months = part(r"^-?P[^T]*?([0-9]+)Y") * 12 + part(r"^-?P[^T]*?([0-9]+)M")
    clock = part(r"([0-9]+)D") * 86_400 + part(r"T.*?([0-9]+)H") * 3600 + part(r"T.*?([0-9]+)M") * 60
    second = F.coalesce(F.regexp_extract(v, r"T.*?([0-9]+(?:\.[0-9]{1,18})?)[0-9]*S", 1).try_cast(exact), F.lit(0).cast(exact))
    whole = F.struct(F.when(v.startswith("-"), -1).otherwise(1).alias("sign"), months.alias("months"), (clock.cast(exact) + second).cast(exact).alias("seconds"))
    out = let(whole, lambda x: F.struct((x["months"] * x["sign"]).alias("months"), (x["seconds"] * x["sign"]).cast(exact).alias("seconds")))
    return out if normal else F.when(c.isNotNull() & is_valid(c, "duration"), out)


#: The four starts (year and month) by which durations are compared: days from each to the starts of later months differ.
STARTS = ((1696, 9), (1697, 2), (1903, 3), (1903, 7))


def compare_durations(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null where the starts disagree (as P1M and P30D do)."""
    def after(d: Column, start: tuple[int, int]) -> Column:
        at = F.lit(start[0] * 12 + start[1] - 1).cast("long") + d["months"]
        return days(F.floor(at / 12), at - F.floor(at / 12) * 12 + 1, F.lit(1)) * F.lit(86_400).cast("decimal(10,0)") + d["seconds"]

    def signs(x: Column) -> Column:
        return F.array_distinct(F.array(*(F.signum(after(x["a"], s) - after(x["b"], s)).cast("int") for s in STARTS)))

    found = let(F.struct(a.alias("a"), b.alias("b")), signs)
    return let(found, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))


def compare_instants(a: Column, a_zoned: Column, b: Column, b_zoned: Column) -> Column:
    """-1, 0 or 1; null where one has no zone and the other lies within 14 hours of it."""
    both = F.struct((a - b).alias("apart"), (a_zoned == b_zoned).alias("alike"))
    return let(both, lambda x: F.when(x["alike"] | (F.abs(x["apart"]) > 14 * 3600), F.signum(x["apart"]).cast("int")))


def decimal_parts(v: Column) -> Column:
    """sign, digits before the point, their number, and digits after it, of a valid decimal of any size."""
    whole = F.ltrim(F.regexp_extract(v, r"^[+-]?([0-9]*)", 1), F.lit("0"))
    part = F.rtrim(F.regexp_extract(v, r"\.([0-9]*)$", 1), F.lit("0"))
    halves = F.struct(v.startswith("-").alias("minus"), whole.alias("whole"), part.alias("part"))
    sign = lambda x: F.when((x["whole"] == "") & (x["part"] == ""), 0).when(x["minus"], -1).otherwise(1)
    return let(halves, lambda x: F.struct(sign(x).alias("sign"), F.length(x["whole"]).alias("size"), x["whole"].alias("whole"), x["part"].alias("part")))


def compare_decimals(a: Column, b: Column) -> Column:
    """-1, 0 or 1 of two ``decimal_parts``."""
    size = lambda x: F.struct(x["size"], x["whole"], x["part"])

    def sign(x: Column) -> Column:
        a, b = x["a"], x["b"]
        larger = F.when(size(a) > size(b), 1).when(size(a) < size(b), -1).otherwise(0)
        return F.when(a["sign"] != b["sign"], F.when(a["sign"] > b["sign"], 1).otherwise(-1)).otherwise(larger * a["sign"])

    return let(F.struct(a.alias("a"), b.alias("b")), sign)


def qname(c: Column, prefixes: Column) -> Column:
    """The Clark form ``{namespace}local`` of a QName, by a map of prefixes ('' is the default); null for unbound ones."""
    v = normalized(c, "QName")
    prefix, local = F.regexp_extract(v, "^([^:]*):", 1), F.regexp_replace(v, "^[^:]*:", "")
    ns = F.try_element_at(prefixes, prefix)
    return F.when(is_valid(c, "QName") & ((prefix == "") | ns.isNotNull()), F.concat(F.when(F.coalesce(ns, F.lit("")) != "", F.concat(F.lit("{"), ns, F.lit("}"))).otherwise(""), local))
