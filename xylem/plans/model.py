"""What callers ask of a schema set on the driver: a mapping of its elements, their types and facets, and single documents.

DataFrames of documents go through :mod:`xylem.operators.documents`, tables of components through ``operators.catalog``.
"""

from __future__ import annotations

import datetime as dt
import html
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, fields
from decimal import Decimal
from typing import TYPE_CHECKING

from ..functions.builtins import BUILTINS, XSD, XSI
from ..functions.facets import Simple
from .automata import automaton, children as children_of
from .schema import Complex, Diagnostic, Element, Group, GroupRef, Name, Particle, SchemaSet, Wildcard
from .values import ATTO, Duration, Temporal, compiled, parse, space

if TYPE_CHECKING:
    from pyspark.sql import Column

_HIDDEN = (XSD, XSI, "http://www.w3.org/XML/1998/namespace")
#: What each code says, in a few words.
CODES = {
    "XSD1001": "no well-formed XML", "XSD1002": "no schema document", "XSD1003": "an element that XSD does not have there", "XSD1004": "an attribute is missing", "XSD1005": "an attribute's value is not of its form",
    "XSD1006": "an unknown encoding", "XSD1007": "bytes that are not of their encoding", "XSD1008": "a misplaced annotation", "XSD1009": "an element is missing", "XSD1101": "a location that leads nowhere",
    "XSD1102": "an included document of another namespace", "XSD1103": "an imported document of another namespace", "XSD1104": "known, but not supported here", "XSD1201": "a name that nothing has", "XSD1202": "a name that two have",
    "XSD1203": "a definition by itself", "XSD1301": "more than one variety", "XSD1302": "an occurrence that can't be", "XSD1303": "two definitions of one thing", "XSD1304": "an ambiguous content model",
    "XSD1305": "a facet that does not apply", "XSD1306": "a facet's value that is none", "XSD1307": "facets that exclude each other", "XSD1308": "a default or fixed value that is not valid", "XSD1309": "a derivation that is final",
    "XSD1310": "a restriction that widens", "XSD2001": "an element that is not declared", "XSD2002": "an unexpected element", "XSD2003": "incomplete content", "XSD2004": "a value that is not of its type", "XSD2005": "an attribute that is not allowed",
    "XSD2006": "a required attribute is missing", "XSD2007": "text where none may be", "XSD2008": "an xsi:type that can't be", "XSD2009": "a nil element with content", "XSD2010": "an abstract type", "XSD2011": "an ID that comes twice",
    "XSD2012": "a reference to no ID", "XSD2013": "an abstract element", "XSD2014": "a key that comes twice", "XSD2015": "a key without a field", "XSD2016": "a reference to no key", "XSD2017": "an unknown entity",
    "XSD2018": "two types for one element", "XSD2019": "a nil that is not allowed",
}
#: Codes of documents that could not be read at all.
UNREAD = ("XSD1001", "XSD1006", "XSD1007", "XSD2017")


def clark(n: Name) -> str:
    return f"{{{n[0]}}}{n[1]}" if n[0] else n[1]


def name_of(x: object) -> Name | None:
    """A name given as Clark text, as a bare local name or as a pair."""
    if isinstance(x, tuple):
        return (x[0] or None, x[1]) if len(x) == 2 else None
    if not isinstance(x, str):
        return None
    ns, _, local = x[1:].rpartition("}") if x.startswith("{") else (None, "", x)
    return ns or None, local


class Tree(str):
    """Text to be looked at: it shows as itself."""

    __slots__ = ()

    def __repr__(self) -> str:
        return str(self)

    def _repr_html_(self) -> str:
        return f"<pre>{html.escape(str(self))}</pre>"


def _rows(title: str, rows: Iterable[tuple[str, object]]) -> str:
    body = "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(str(v))}</td></tr>" for k, v in rows if v is not None)
    return f"<table><caption>{html.escape(title)}</caption>{body}</table>"


@dataclass(frozen=True)
class Facets:
    length: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    patterns: list[list[str]] = field(default_factory=list)
    enumeration: list[str] | None = None
    white_space: str | None = None
    max_inclusive: str | None = None
    max_exclusive: str | None = None
    min_inclusive: str | None = None
    min_exclusive: str | None = None
    total_digits: int | None = None
    fraction_digits: int | None = None
    explicit_timezone: str | None = None
    min_scale: int | None = None
    max_scale: int | None = None

    @classmethod
    def of(cls, own: Mapping[str, object], patterns: Iterable[Iterable[str]], white: str | None) -> Facets:
        snake = {"".join("_" + c.lower() if c.isupper() else c for c in k): v for k, v in own.items()}
        known = {f.name for f in fields(cls)} - {"patterns", "white_space", "enumeration"}
        text = lambda k, v: str(v) if k.endswith("clusive") else v
        return cls(patterns=[list(p) for p in patterns], white_space=white, enumeration=[str(x) for x in own["enumeration"]] if "enumeration" in own else None, **{k: text(k, v) for k, v in snake.items() if k in known})

    def _repr_html_(self) -> str:
        return _rows("facets", ((f.name, getattr(self, f.name)) for f in fields(self) if getattr(self, f.name) not in (None, [])))


class Ref:
    """A component of a model."""

    def __init__(self, model: Model, of: object) -> None:
        self.model, self.of = model, of

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.of is other.of and self.model.set is other.model.set

    def __hash__(self) -> int:
        return hash(id(self.of))

    def __repr__(self) -> str:
        return f"<{type(self).__name__} {self.qname}>"

    @property
    def name(self) -> Name | None:
        n = self.of.name
        return n if n is None or isinstance(n, tuple) else name_of(n) if n not in BUILTINS else (XSD, n)

    @property
    def qname(self) -> str | None:
        return clark(self.name) if self.name else None

    @property
    def local_name(self) -> str | None:
        return self.name[1] if self.name else None

    @property
    def namespace(self) -> str | None:
        return self.name[0] if self.name else None

    def _noted(self, kind: str) -> dict:
        return self.model.set.docs.get((kind, self.name), {})


class AttributeRef(Ref):
    @property
    def type(self) -> TypeRef:
        return TypeRef(self.model, self.model.set.type_of(self.of.type))

    @property
    def default(self) -> str | None:
        return self.of.default

    @property
    def fixed(self) -> str | None:
        return self.of.fixed

    @property
    def doc(self) -> str | None:
        return self._noted("attributes").get("doc")

    @property
    def appinfo(self) -> list:
        return self._noted("attributes").get("appinfo", [])


class AttributeUse(AttributeRef):
    """An attribute as a type uses it: what the use says goes before the declaration."""

    @property
    def attribute(self) -> AttributeRef:
        return AttributeRef(self.model, self.model.set.attributes.get(self.of.name, self.of))

    @property
    def use(self) -> str:
        return self.of.use

    @property
    def required(self) -> bool:
        return self.of.use == "required"


class _Holder(Ref):
    """Elements and types: what they hold."""

    def _type(self) -> object:
        raise NotImplementedError

    @property
    def children(self) -> list[Child]:
        t, s = self._type(), self.model.set
        if not isinstance(t, Complex):
            return []
        names = automaton(s, t).names
        out = []
        for n, repeats, optional in children_of(s, t):
            e = next((m[n] for m in names if m.get(n) is not None), None)
            if e is not None:
                out.append(Child(self.model, e, repeats, optional))
        return out

    @property
    def attributes(self) -> list[AttributeUse]:
        t = self._type()
        return [AttributeUse(self.model, a) for a in self.model.set.attributes_of(t)[0].values()] if isinstance(t, Complex) else []

    def accepts(self, names: Iterable[object]) -> bool:
        """Whether children of these names, in this order, are a whole content."""
        t = self._type()
        if not isinstance(t, Complex) or t.content == "simple":
            return not list(names)
        local = {c.local_name: c.name for c in self.children}
        return automaton(self.model.set, t).accepts([local.get(n, name_of(n)) if isinstance(n, str) and not n.startswith("{") else name_of(n) for n in names])

    def __len__(self) -> int:
        return len(self.children)

    def __bool__(self) -> bool:
        return True

    def __iter__(self) -> Iterator[Child]:
        return iter(self.children)

    def __getitem__(self, name: object) -> Child:
        want, found = name_of(name), self.children
        hit = [c for c in found if c.name == want] or [c for c in found if isinstance(name, str) and c.local_name == name]
        if not hit:
            raise KeyError(name)
        return hit[0]

    def tree(self, depth: int = 3) -> Tree:
        """An indented outline: ``?`` optional, ``+`` one or more, ``*`` any number, ``@`` attributes; where a type comes
        again within itself, or below ``depth``, it ends in ``...``."""
        lines: list[str] = []

        def label(t: object) -> str:
            ref = TypeRef(self.model, t)
            if isinstance(t, Simple):
                shown = ref.name if ref.name else (XSD, t.builtin)
                return f": xs:{shown[1]}" if shown[0] == XSD else f": {shown[1]}"
            return ""

        def put(t: object, level: int, path: tuple[int, ...]) -> None:
            ref = TypeRef(self.model, t)
            if level > depth or id(t) in path:
                if len(ref) or ref.attributes:
                    lines.append("  " * level + "...")
                return
            for a in ref.attributes:
                lines.append("  " * level + f"@{a.local_name}" + ("" if a.required else "?") + (label(a.type.of) if a.type.local_name != "anySimpleType" else ""))
            for c in ref.children:
                mark = {(False, False): "", (False, True): "?", (True, False): "+", (True, True): "*"}[(c.repeats, c.optional)]
                lines.append("  " * level + c.local_name + mark + label(c.type.of))
                put(c.type.of, level + 1, (*path, id(t)))

        lines.append((self.local_name or "(anonymous)") + label(self._type()))
        put(self._type(), 1, ())
        return Tree("\n".join(lines))

    def _repr_html_(self) -> str:
        return self.tree()._repr_html_()


class ElementRef(_Holder):
    def _type(self) -> object:
        return self.model.set.type_of(self.of.type)

    @property
    def type(self) -> TypeRef:
        return TypeRef(self.model, self._type())

    @property
    def nillable(self) -> bool:
        return self.of.nillable

    @property
    def abstract(self) -> bool:
        return self.of.abstract

    @property
    def is_global(self) -> bool:
        return self.of.is_global

    @property
    def default(self) -> str | None:
        return self.of.default

    @property
    def fixed(self) -> str | None:
        return self.of.fixed

    @property
    def substitutes(self) -> list[ElementRef]:
        """The elements that may stand in this one's place, without itself."""
        s = self.model.set
        return [ElementRef(self.model, s.elements[n]) for n in s.permitted(self.of.name) if n != self.of.name] if self.of.is_global else []

    @property
    def doc(self) -> str | None:
        return self._noted("elements").get("doc") if self.of.is_global else None

    @property
    def appinfo(self) -> list:
        return self._noted("elements").get("appinfo", []) if self.of.is_global else []


class Child(ElementRef):
    """An element where a content model has it."""

    def __init__(self, model: Model, of: Element, repeats: bool, optional: bool) -> None:
        super().__init__(model, of)
        self.repeats, self.optional = repeats, optional

    @property
    def element(self) -> ElementRef:
        return ElementRef(self.model, self.of)


class TypeRef(_Holder):
    def _type(self) -> object:
        return self.of

    @property
    def is_complex(self) -> bool:
        return isinstance(self.of, Complex)

    @property
    def is_simple(self) -> bool:
        return isinstance(self.of, Simple)

    @property
    def abstract(self) -> bool:
        return self.is_complex and self.of.abstract

    @property
    def base(self) -> TypeRef | None:
        chain = self.base_chain
        return chain[1] if len(chain) > 1 else None

    @property
    def base_chain(self) -> list[TypeRef]:
        """The type and its bases, up to anyType."""
        s, out, t = self.model.set, [], self.of
        while t is not None and not any(x is t for x in out):
            out.append(t)
            if isinstance(t, Complex):
                t = s.type_of(t.base) if t.base is not None else None
            elif t.name in BUILTINS and s.types.get((XSD, t.name)) is t:
                t = s.types[(XSD, BUILTINS[t.name].base)] if BUILTINS[t.name].base else s.types[(XSD, "anyType")]
            else:
                up = s.simple_base.get(t.name or "", [])
                t = s.types.get(up[0]) if up else s.types[(XSD, "anySimpleType" if t.item or t.members else t.builtin)]
        return [TypeRef(self.model, x) for x in out]

    @property
    def derivation(self) -> str | None:
        return self.of.derivation if self.is_complex else None

    def derives_from(self, other: TypeRef) -> bool:
        return self.model.set.derives_from(self.of, other.of)

    @property
    def content(self) -> str | None:
        """empty, simple, elements or mixed."""
        if not self.is_complex:
            return None
        if self.model.set.simple_of(self.of) is not None:
            return "simple"
        return "mixed" if self.model.set.mixed(self.of) else "elements" if automaton(self.model.set, self.of).terms else "empty"

    @property
    def content_model(self) -> str | None:
        """sequence, choice or all."""
        parts = self.model.set.particles_of(self.of) if self.is_complex else []
        if not parts:
            return None
        term = parts[0].term
        term = self.model.set.groups.get(term.name) if isinstance(term, GroupRef) else term
        return "sequence" if len(parts) > 1 else term.kind if isinstance(term, Group) else None

    @property
    def stats(self) -> dict[str, int]:
        """Positions, moves between them, and whether counts are approximated, of the content automaton."""
        a = automaton(self.model.set, self.of) if self.is_complex else None
        return {"positions": len(a.terms), "moves": sum(map(len, a.follow)) + len(a.first), "wildcards": sum(isinstance(t, Wildcard) for t in a.terms), "approximated": int(a.approximated)} if a else {}

    @property
    def simple(self) -> Simple | None:
        return self.model.set.simple_of(self.of)

    def check(self, c: Column) -> Column:
        """The same checks as a Column: null for valid values, else what fails first."""
        from ..functions.facets import check

        return check(c, self.simple, self.model.set.version)

    def validate(self, lexical: str, namespaces: Mapping[str, str] | None = None) -> object:
        """The value of a lexical form, natively where Python has its type; raises ValueError where it is none."""
        t = self.simple
        if t is None:
            raise ValueError(f"{self.qname} has no text")
        why, canon, _, own = compiled(t, self.model.set.version).look(lexical)
        if why is not None:
            raise ValueError(f"{lexical!r} fails {why}")
        if not own.item and own.builtin in ("QName", "NOTATION"):
            prefix, _, local = canon.rpartition(":")
            if prefix and (not namespaces or prefix not in namespaces):
                raise ValueError(f"the prefix of {canon} is not bound")
            return clark(((namespaces or {}).get(prefix) or None, local))
        return native(lexical, own)

    def is_valid(self, lexical: str, namespaces: Mapping[str, str] | None = None) -> bool:
        try:
            self.validate(lexical, namespaces)
        except ValueError:
            return False
        return True

    @property
    def variety(self) -> str | None:
        t = self.simple
        return None if t is None else "list" if t.item or BUILTINS[t.builtin].item else "union" if t.members else "atomic"

    @property
    def builtin(self) -> str | None:
        t = self.simple
        return t.builtin if t is not None and not t.item and not t.members else None

    @property
    def primitive(self) -> str | None:
        return BUILTINS[self.builtin].primitive if self.builtin else None

    @property
    def item_type(self) -> TypeRef | None:
        t = self.simple
        item = None if t is None else t.item or (self.model.set.types.get((XSD, BUILTINS[t.builtin].item)) if BUILTINS[t.builtin].item else None)
        return TypeRef(self.model, item) if item is not None else None

    @property
    def member_types(self) -> list[TypeRef]:
        """In the order in which they are tried."""
        return [TypeRef(self.model, m) for m in (self.simple.members if self.simple else ())]

    @property
    def facets(self) -> Facets | None:
        """Those in force, of all steps together."""
        t = self.simple
        return Facets.of(t.facets, t.patterns, t.whitespace) if t is not None else None

    @property
    def declared_facets(self) -> Facets | None:
        """Those of the type's own step."""
        if self.simple is None:
            return None
        own, patterns = self.model.set.declared.get(self.name, ({}, []))
        return Facets.of({k: v for k, v in own.items() if k != "whiteSpace"}, [patterns] if patterns else [], own.get("whiteSpace"))

    @property
    def doc(self) -> str | None:
        return self._noted("types").get("doc") if self.name else None

    @property
    def appinfo(self) -> list:
        return self._noted("types").get("appinfo", []) if self.name else []


def native(lexical: str, t: Simple) -> object:
    """A valid value as Python has it, where nothing is lost; else its canonical text."""
    if t.item or BUILTINS[t.builtin].item and not t.members:
        item = t.item or Simple(BUILTINS[t.builtin].item, BUILTINS[t.builtin].item)
        return [native(x, compiled(item).look(x)[3]) for x in space(lexical, "collapse").split(" ") if x]
    c = compiled(t)
    if t.members:
        return native(lexical, c.look(lexical)[3])
    v, b = space(lexical, t.whitespace), BUILTINS[t.builtin]
    x = parse(v, t.builtin)
    if isinstance(x, Decimal):
        return int(x) if b.low is not None or b.high is not None else x
    if isinstance(x, bool | float | bytes):
        return x
    if isinstance(x, Duration) and not x.months and not x.attos % 10**12:
        try:
            return dt.timedelta(microseconds=x.attos // 10**12)
        except OverflowError:
            return str(x)
    if isinstance(x, Temporal) and 1 <= x.year <= 9999 and not x.attos % 10**12:
        zone = None if x.zone is None else dt.timezone(dt.timedelta(minutes=x.zone))
        seconds, micros = x.attos // ATTO, x.attos % ATTO // 10**12
        clock = dt.time(seconds // 3600, seconds // 60 % 60, seconds % 60, micros, zone)
        if x.kind == "dateTime":
            return dt.datetime.combine(dt.date(x.year, x.month, x.day), clock)
        if x.kind == "time":
            return clock
        if x.kind == "date" and zone is None:
            return dt.date(x.year, x.month, x.day)
    return c.look(lexical)[1]


class Named(Mapping):
    """Global components of one kind, in order, by name or number."""

    def __init__(self, rows: dict[Name, Ref]) -> None:
        self.rows = rows

    def __getitem__(self, key: object) -> Ref:
        if isinstance(key, int):
            return list(self.rows.values())[key]
        n = name_of(key)
        if n in self.rows:
            return self.rows[n]
        bare = [r for m, r in self.rows.items() if isinstance(key, str) and m[1] == key]
        if len(bare) != 1:
            raise KeyError(key)
        return bare[0]

    def __contains__(self, key: object) -> bool:
        try:
            self[key]
        except (KeyError, IndexError):
            return False
        return True

    def __iter__(self) -> Iterator[str]:
        return (clark(n) for n in self.rows)

    def __len__(self) -> int:
        return len(self.rows)


@dataclass
class Report:
    """The outcome of one document."""

    diagnostics: list[Diagnostic]

    @property
    def errors(self) -> list[Diagnostic]:
        return [d for d in self.diagnostics if d.severity == "error"]

    @property
    def is_valid(self) -> bool:
        return not self.errors

    def __bool__(self) -> bool:
        return self.is_valid

    def _repr_html_(self) -> str:
        return _rows("valid" if self.is_valid else "not valid", ((d.code, f"{d.message} (line {d.line})") for d in self.diagnostics))


class DocumentError(ValueError):
    def __init__(self, report: Report) -> None:
        super().__init__("; ".join(f"{d.code}: {d.message}" for d in report.errors[:5]))
        self.report, self.diagnostics = report, report.diagnostics


class TypedEvents(Iterator):
    """One document's events as they are read; an iterator that is dropped stops the reading."""

    def __init__(self, model: Model, xml: str | bytes, uri: str | None) -> None:
        from ..operators.validator import Events, Validator

        self._sink = Events()
        self._validator = Validator(model.set, self._sink)
        self._parts, self._uri, self._ready, self._done = self._validator.stream(xml), uri, iter(()), False

    def __next__(self) -> dict:
        while True:
            got = next(self._ready, None)
            if got is not None:
                return got
            if self._done:
                raise StopIteration
            self._done = next(self._parts, None) is None
            rows = self._sink.tree(self._validator)
            self._sink.clear()
            self._ready = iter(rows)

    @property
    def report(self) -> Report:
        if not self._done:
            raise RuntimeError("the outcome is known once all events are read")
        return Report([Diagnostic(c, m, s, self._uri, line) for c, m, line, s in self._validator.diags])


class Model(Mapping):
    """A schema set as callers see it; a mapping of its global elements by Clark name."""

    def __init__(self, schemas: SchemaSet) -> None:
        self.set = schemas
        self._validator: object = None

    # -- making one -----------------------------------------------------------------------------------

    @classmethod
    def from_string(cls, text: str, uri: str = "memory:schema.xsd", **options) -> Model:
        return cls(SchemaSet.load((text, uri), **options))

    @classmethod
    def from_bytes(cls, data: bytes, uri: str = "memory:schema.xsd", **options) -> Model:
        return cls(SchemaSet.load((data, uri), **options))

    @classmethod
    def from_file(cls, path: str, **options) -> Model:
        return cls(SchemaSet.from_file(path, **options))

    @classmethod
    def from_files(cls, paths: Iterable[str], **options) -> Model:
        return Builder(**options).files(*paths).build()

    def serialize(self) -> bytes:
        return self.set.serialize()

    @classmethod
    def deserialize(cls, data: bytes) -> Model:
        return cls(SchemaSet.deserialize(data))

    def __copy__(self) -> Model:
        return Model(self.set)

    def __deepcopy__(self, memo: dict) -> Model:
        return Model(self.set)

    # -- looking --------------------------------------------------------------------------------------

    def __getitem__(self, name: object) -> ElementRef:
        return self.elements[name]

    def __contains__(self, name: object) -> bool:
        return name in self.elements

    def __iter__(self) -> Iterator[str]:
        return iter(self.elements)

    def __len__(self) -> int:
        return len(self.set.elements)

    @property
    def elements(self) -> Named:
        return Named({n: ElementRef(self, e) for n, e in self.set.elements.items()})

    @property
    def types(self) -> Named:
        return Named({n: TypeRef(self, t) for n, t in self.set.types.items() if n[0] not in _HIDDEN})

    @property
    def attributes(self) -> Named:
        return Named({n: AttributeRef(self, a) for n, a in self.set.attributes.items() if n[0] not in _HIDDEN})

    def _found(self, space_: dict, kind: type, namespace: object, local: str | None) -> Ref | None:
        n = (namespace or None, local) if local is not None else name_of(namespace)
        hit = space_.get(n)
        if hit is None and local is None and isinstance(namespace, str) and not namespace.startswith("{"):
            bare = [x for m, x in space_.items() if m[1] == namespace and m[0] not in _HIDDEN]
            hit = bare[0] if len(bare) == 1 else None
        return kind(self, hit) if hit is not None else None

    def element(self, namespace: object, local: str | None = None) -> ElementRef | None:
        return self._found(self.set.elements, ElementRef, namespace, local)

    def type(self, namespace: object, local: str | None = None) -> TypeRef | None:
        return self._found(self.set.types, TypeRef, namespace, local)

    def attribute(self, namespace: object, local: str | None = None) -> AttributeRef | None:
        return self._found(self.set.attributes, AttributeRef, namespace, local)

    @property
    def documents(self) -> list[dict]:
        return self.set.documents

    @property
    def diagnostics(self) -> list[Diagnostic]:
        return self.set.diagnostics

    def counts(self) -> dict[str, int]:
        """How many components of each kind, what XSD brings along included in none."""
        s = self.set
        particles, local, inner = 0, 0, 0

        def walk(p: Particle | None) -> None:
            nonlocal particles, local, inner
            if p is None:
                return
            particles += 1
            if isinstance(p.term, Element):
                local += 1
                if isinstance(p.term.type, Complex):
                    inner += 1
                    walk(p.term.type.particle)
            elif isinstance(p.term, Group):
                for x in p.term.items:
                    walk(x)

        own = [t for n, t in s.types.items() if n[0] != XSD]
        for t in own:
            walk(t.particle if isinstance(t, Complex) else None)
        for g in s.groups.values():
            for x in g.items:
                walk(x)
        for e in s.elements.values():
            if isinstance(e.type, Complex):
                inner += 1
                walk(e.type.particle)
        return {"elements": len(s.elements), "local_elements": local, "types": len(own), "anonymous_types": inner, "attributes": len(self.attributes), "groups": len(s.groups), "attribute_groups": len(s.attribute_groups),
                "particles": particles, "identity_constraints": sum(len(e.keys) for e in s.elements.values()), "notations": len(s.notations), "documents": len(s.documents)}

    def _repr_html_(self) -> str:
        return _rows("schema set", self.counts().items())

    # -- single documents -----------------------------------------------------------------------------

    def validate(self, xml: str | bytes, uri: str | None = None) -> Report:
        """Never raises: what is wrong is in the report."""
        from ..operators.validator import Validator

        if self._validator is None:
            self._validator = Validator(self.set)
        return Report([Diagnostic(c, m, s, uri, line) for c, m, line, s in self._validator.run(xml)])

    def decode(self, xml: str | bytes, lax: bool = False, root: bool = False, uri: str | None = None) -> object:
        """The document as Python values: what may repeat is a list, attributes are ``@name``, text beside them is ``$``, nil
        is None; names are local unless the schema has them in two namespaces.  Raises for an invalid document unless
        ``lax``, and always for one that is no XML."""
        from ..operators.validator import Validator

        sink = _Values(self)
        report = Report([Diagnostic(c, m, s, uri, line) for c, m, line, s in Validator(self.set, sink).run(xml)])
        if report.errors and (not lax or any(d.code in UNREAD for d in report.errors)):
            raise DocumentError(report)
        return {sink.root: sink.value} if root else sink.value

    def iter_typed(self, xml: str | bytes, uri: str | None = None) -> TypedEvents:
        return TypedEvents(self, xml, uri)

    def read_typed(self, xml: str | bytes, uri: str | None = None) -> tuple[list[dict], Report]:
        events = self.iter_typed(xml, uri)
        return list(events), events.report


class _Values:
    """A validator's sink that folds one document into Python values."""

    def __init__(self, model: Model) -> None:
        self.model, self.root, self.value = model, None, None
        names: dict[str, set] = {}
        for n in self._names(model.set):
            names.setdefault(n[1], set()).add(n[0])
        self.alike = {x for x, spaces in names.items() if len(spaces) > 1}
        self.lists: dict[int, set[Name]] = {}

    @staticmethod
    def _names(s: SchemaSet) -> Iterator[Name]:
        from .rules import _elements

        yield from s.elements
        holders = [t for t in s.types.values() if isinstance(t, Complex)] + [e.type for e in s.elements.values() if isinstance(e.type, Complex)]
        for t in holders:
            yield from (e.name for e in _elements(s, t.particle))

    def key(self, n: Name) -> str:
        return clark(n) if n[1] in self.alike else n[1]

    def repeating(self, t: object) -> set[Name]:
        if id(t) not in self.lists:
            self.lists[id(t)] = {n for n, repeats, _ in children_of(self.model.set, t) if repeats} if isinstance(t, Complex) else set()
        return self.lists[id(t)]

    def start(self, v, f, parent) -> None:
        row = {}
        for name, lexical, canon, _, _ in f.attributes:
            n = name_of(name)
            use = f.plan.uses.get(f"{n[0]} {n[1]}" if n[0] else n[1])
            row["@" + (clark(n) if n[0] else n[1])] = native(lexical, use.check.look(lexical)[3]) if use is not None and canon is not None else lexical
        for n in self.repeating(f.plan.type):
            row.setdefault(self.key(n), [])
        f.node = row

    def end(self, v, f, lexical, canon, supplied) -> None:
        row = f.node
        value = lexical
        if lexical is not None and canon is not None and f.plan.check is not None:
            value = native(lexical, f.plan.check.look(lexical)[3])
        scalar = f.plan.check is not None and not f.plan.uses and not row
        done = None if f.nil else value if scalar else row | ({"$": value} if value is not None else {})
        if f.plan.skip and not row:
            done = f.text or ""
        ns, _, local = f.raw.rpartition(" ")
        n = (ns or None, local)
        if len(v.stack) == 1:
            self.root, self.value = self.key(n), done
            return
        up, k = v.stack[-2].node, self.key(n)
        if n in self.repeating(v.stack[-2].plan.type):
            up[k].append(done)
        elif k in up:  # a wildcard's child: a list from the second on
            up[k] = [*up[k], done] if isinstance(up[k], list) else [up[k], done]
        else:
            up[k] = done


class Builder:
    """Collects sources and options, then builds."""

    def __init__(self, **options) -> None:
        self.options, self.sources = dict(options), []

    def _with(self, **more) -> Builder:
        self.options |= more
        return self

    def version(self, v: str) -> Builder:
        return self._with(version=v)

    def conformance(self, mode: str) -> Builder:
        return self._with(conformance=mode)

    def resolver(self, f: Callable) -> Builder:
        return self._with(resolver=f)

    def search_path(self, *folders: str) -> Builder:
        return self._with(search_path=tuple(folders))

    def max_depth(self, n: int) -> Builder:
        return self._with(max_depth=n)

    def nodes_limit(self, n: int) -> Builder:
        return self._with(nodes_limit=n)

    def file(self, path: str) -> Builder:
        with open(path, "rb") as f:
            self.sources.append((f.read(), path))
        return self

    def files(self, *paths: str) -> Builder:
        for p in paths:
            self.file(p)
        return self

    def text(self, data: str | bytes, uri: str = "memory:schema.xsd") -> Builder:
        self.sources.append((data, uri))
        return self

    def build(self) -> Model:
        return Model(SchemaSet.load(*self.sources, **self.options))


def _loaded(*sources: tuple[str | bytes, str], **options) -> tuple[Model, list[Diagnostic]]:
    model = Model(SchemaSet.load(*sources, **{"conformance": "lax"} | options))
    return model, list(model.set.diagnostics)


def load(path: str, **options) -> tuple[Model, list[Diagnostic]]:
    """A file's model and all its diagnostics; lax, so that errors are told and not raised."""
    return load_files([path], **options)


def load_files(paths: Iterable[str], **options) -> tuple[Model, list[Diagnostic]]:
    found = []
    for p in paths:
        with open(p, "rb") as f:
            found.append((f.read(), p))
    return _loaded(*found, **options)


def load_string(text: str, uri: str = "memory:schema.xsd", **options) -> tuple[Model, list[Diagnostic]]:
    return _loaded((text, uri), **options)


def load_bytes(data: bytes, uri: str = "memory:schema.xsd", **options) -> tuple[Model, list[Diagnostic]]:
    return _loaded((data, uri), **options)

