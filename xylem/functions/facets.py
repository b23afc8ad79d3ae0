"""Simple types with facets, compiled to Column expressions.

A type is a chain of restriction steps over a built-in, a list of items, or a
union.  ``check`` gives null for a valid value, else the name of what failed
first, in the order pattern, value, length, scale, enumeration, time zone, bounds,
digits.  Values are compared as values: dates by instants, durations by four starts,
decimals exactly at any size; the rules are those of ``plans.values``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexical
from .builtins import BUILTINS, TEMPORAL
from .patterns import anchored


@dataclass(frozen=True)
class Simple:
    """``builtin`` is what values are parsed as; ``item`` makes a list, ``members`` a union."""

    builtin: str = "string"
    name: str | None = None
    patterns: tuple[tuple[str, ...], ...] = ()  # all steps hold, in a step any
    facets: dict[str, object] = field(default_factory=dict)
    item: Simple | None = None
    members: tuple[Simple, ...] = ()
    space: str | None = None

    def restrict(self, patterns: tuple[str, ...] = (), name: str | None = None, **facets: object) -> Simple:
        """One more step: patterns are added as a step of their own, other facets replace inherited ones; an inclusive and an
        exclusive bound on one side displace each other."""
        own = dict(self.facets)
        for a, b in (("minInclusive", "minExclusive"), ("maxInclusive", "maxExclusive")):
            if a in facets:
                own.pop(b, None)
            if b in facets:
                own.pop(a, None)
        space = facets.pop("whiteSpace", self.space)
        return Simple(self.builtin, name or self.name, (*self.patterns, tuple(patterns)) if patterns else self.patterns, own | facets, self.item, self.members, space)

    @property
    def whitespace(self) -> str:
        return self.space or ("collapse" if self.item or self.members else BUILTINS[self.builtin].space)


def _first(*tests: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(bad, F.lit(what)) for bad, what in tests), F.lit(None).cast("string"))


def compare(v: Column, t: Simple, literal: str) -> Column:
    """-1, 0 or 1 of a valid, normalised value of an atomic type against a literal; null where they are not ordered."""
    from ..plans.values import order, parse, space

    b, literal = BUILTINS[t.builtin], space(literal, "collapse")
    if b.low is not None or b.high is not None:
        long = b.low is not None and b.high is not None and max(-b.low, b.high) < 2**63 and abs(int(literal)) < 2**63
        kind = "long" if long else "decimal(38,0)"
        return F.signum(v.try_cast(kind) - F.lit(literal).cast(kind)).cast("int") if not long else _sign(v.try_cast(kind), F.lit(int(literal)))
    if b.primitive == "decimal":
        return lexical.compare_decimals(lexical.decimal_parts(v), lexical.decimal_parts(F.lit(literal)))
    if b.primitive in ("float", "double"):
        x, y = lexical.value(v, t.builtin), parse(literal, t.builtin)
        return F.when(~F.isnan(x) & F.lit(y == y), _sign(x, F.lit(y).cast(b.primitive)))
    if b.primitive in TEMPORAL:
        y = F.lit(literal)
        return lexical.compare_instants(lexical.instant(v, b.primitive), lexical.zoned(v), lexical.instant(y, b.primitive), lexical.zoned(y))
    if b.primitive == "duration":
        return lexical.compare_durations(lexical.duration(v, True), lexical.duration(F.lit(literal), True))
    assert order(literal, literal) is None  # the others have no order
    return F.lit(None).cast("int")


def _sign(a: Column, b: Column) -> Column:
    return F.when(a > b, 1).when(a < b, -1).otherwise(0)


def equals(v: Column, t: Simple, literals: list[str]) -> Column:
    """Whether a valid, normalised value equals one of the literals, as values."""
    from ..plans.values import Compiled, compiled

    plain = Simple(t.builtin, item=t.item, members=t.members, space=t.space)
    if t.members:
        # a literal is a value of the first member that takes it, as the value is
        tests = []
        for i, m in enumerate(t.members):
            own = [x for x in literals if next((k for k, n in enumerate(t.members) if compiled(n, "1.1").look(x)[0] is None), None) == i]
            if own:
                tests.append((i, m, own))
        same = lambda x: F.coalesce(*(F.when(x["took"] == i, equals(lexical.whitespace(x["v"], m.whitespace), m, own)) for i, m, own in tests), F.lit(False))
        return lexical.let(F.struct(v.alias("v"), member(v, t).alias("took")), same)
    if t.item:
        items = [[x for x in s.split(" ") if x] for s in literals]
        parts = F.filter(F.split(v, " "), lambda x: x != "")
        same = lambda own: (F.size(parts) == len(own)) & F.forall(F.zip_with(parts, F.array(*map(F.lit, own)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda z: _same(z["a"], z["b"], t.item)) if own else F.size(parts) == 0
        return reduce(lambda a, b: a | b, map(same, items))
    primitive, c = BUILTINS[t.builtin].primitive, Compiled(plain, "1.1")
    good = [x for x in literals if c.look(x)[0] is None]
    if primitive in ("float", "double", "duration") or primitive in TEMPORAL:
        return reduce(lambda a, b: a | b, (_same(v, F.lit(c.look(x)[1]), plain) for x in good), F.lit(False))
    return lexical.canonical(v, t.builtin).isin([c.look(x)[1] for x in good]) if good else F.lit(False)


def _same(a: Column, b: Column, t: Simple) -> Column:
    """Whether two valid values of an atomic type are equal."""
    p = BUILTINS[t.builtin].primitive
    if p in ("float", "double"):
        x, y = lexical.value(a, t.builtin), lexical.value(b, t.builtin)
        return ~F.isnan(x) & (x == y)
    if p in TEMPORAL:
        return (lexical.zoned(a) == lexical.zoned(b)) & (lexical.instant(a, p) == lexical.instant(b, p))
    if p == "duration":
        return lexical.duration(a, True) == lexical.duration(b, True)
    return lexical.canonical(a, t.builtin) == lexical.canonical(b, t.builtin)


def check(c: Column, t: Simple, version: str = "1.0") -> Column:
    return F.when(c.isNotNull(), lexical.let(lexical.whitespace(c, t.whitespace), lambda v: checked(v, t, version)) if not _by_hand(t) else checked(lexical.whitespace(c, t.whitespace), t, version))


def with_check(df: DataFrame, c: Column, t: Simple, name: str, version: str = "1.0") -> DataFrame:
    """``df`` with ``check`` as the column ``name``; white space is normalised once, in a projection of its own."""
    own = f"{name} normal"
    return df.withColumn(own, lexical.whitespace(c, t.whitespace)).withColumn(name, F.when(F.col(f"`{own}`").isNotNull(), checked(F.col(f"`{own}`"), t, version))).drop(own)


def checked(v: Column, t: Simple, version: str = "1.0") -> Column:
    """``check`` of a value that is not null and whose white space is normalised."""
    if _by_hand(t):
        return _by_worker(v, t, version)
    tests: list[tuple[Column, str]] = [(~v.rlike(anchored(list(step))), "pattern") for step in t.patterns]
    f, size = t.facets, None
    if t.members:
        tests.append((member(v, t, version).isNull(), "union"))
    elif t.item:
        items = F.filter(F.split(v, " "), lambda x: x != "")
        tests.append((F.exists(items, lambda x: check(x, t.item, version).isNotNull()), "item"))
        size = F.size(items)
    else:
        b = BUILTINS[t.builtin]
        tests.append((~lexical.is_valid(v, t.builtin, version, True), "value"))
        size = F.octet_length(lexical.value(v, t.builtin)) if b.primitive in ("hexBinary", "base64Binary") else F.size(F.split(v, " ")) if b.item else F.char_length(v)
    if size is not None and not (t.item is None and BUILTINS[t.builtin].primitive in ("QName", "NOTATION")):
        for name, bad in (("length", lambda x: size != x), ("minLength", lambda x: size < x), ("maxLength", lambda x: size > x)):
            if name in f:
                tests.append((bad(F.lit(int(f[name]))), name))
    if "enumeration" in f:
        tests.append((~equals(v, t, [str(x) for x in f["enumeration"]]), "enumeration"))
    if "explicitTimezone" in f:
        zoned = lexical.zoned(v)
        tests.append(({"required": ~zoned, "prohibited": zoned}.get(str(f["explicitTimezone"]), F.lit(False)), "explicitTimezone"))
    for name, bad in (("minInclusive", lambda x: x < 0), ("minExclusive", lambda x: x <= 0), ("maxInclusive", lambda x: x > 0), ("maxExclusive", lambda x: x >= 0)):
        if name in f and not t.item and not t.members:
            # values that can't be compared pass
            tests.append((F.coalesce(bad(compare(v, t, str(f[name]))), F.lit(False)), name))
    if "totalDigits" in f or "fractionDigits" in f:
        parts = lexical.decimal_parts(v)
        if "totalDigits" in f:
            tests.append((F.greatest(parts["size"] + F.length(parts["part"]), F.lit(1)) > int(f["totalDigits"]), "totalDigits"))
        if "fractionDigits" in f:
            tests.append((F.length(parts["part"]) > int(f["fractionDigits"]), "fractionDigits"))
    return _first(*tests)


def _by_hand(t: Simple) -> bool:
    """Whether a type has no safe native form: digits and scales as written, and patterns that repeat a group, whose
    matching in Java takes a stack frame for each time, so that a long value would end the executor."""
    if t.members or t.item:
        return any(map(_by_hand, (*t.members, *([t.item] if t.item else ())))) or _repeats(t)
    return BUILTINS[t.builtin].primitive == "precisionDecimal" or _repeats(t)


def _repeats(t: Simple) -> bool:
    return any(re.search(r"\)(?:[*+]|\{[0-9]+,\}|\{[0-9]*,?[0-9]{3,}\})", p) for step in t.patterns for p in step)


def _by_worker(v: Column, t: Simple, version: str) -> Column:
    import pandas as pd

    def run(values):
        from ..plans.values import compiled

        c = compiled(t, version)
        return values.map(lambda x: None if x is None else c.look(x)[0])

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(v)


def member(c: Column, t: Simple, version: str = "1.0") -> Column:
    """The number (from 0) of the first union member that accepts the value."""
    return lexical.let(c, lambda v: F.coalesce(*(F.when(check(v, m, version).isNull(), F.lit(i)) for i, m in enumerate(t.members)), F.lit(None).cast("int")))
