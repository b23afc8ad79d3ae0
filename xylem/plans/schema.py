"""Schema documents compiled on the driver: a small picklable component set with its diagnostics.

Documents are read through a resolver; include, import, redefine and override
bring in further ones.  Components are plain dataclasses keyed by ``(namespace,
local)`` names; content models become position automata (see ``automata``).
Component tables for Spark are in :mod:`xylem.operators.catalog`.
"""

from __future__ import annotations

import os
import pickle
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING
from xml.parsers import expat

from ..functions.builtins import BUILTINS, XSD, XSI
from ..functions.facets import Simple
from ..functions.patterns import PatternError, translate, unknown_blocks
from .encodings import EncodingProblem, text_of

if TYPE_CHECKING:
    from pyspark.sql import Column

Name = tuple[str | None, str]
UNBOUNDED = -1
VERSION = 1


@dataclass(frozen=True)
class Span:
    uri: str | None
    line: int | None
    label: str | None = None


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    severity: str = "error"
    uri: str | None = None
    line: int | None = None
    help: str | None = None

    @classmethod
    def error(cls, code: str, message: str, **more) -> Diagnostic:
        return cls(code, message, "error", **more)

    @classmethod
    def warning(cls, code: str, message: str, **more) -> Diagnostic:
        return cls(code, message, "warning", **more)

    @property
    def is_error(self) -> bool:
        return self.severity == "error"

    @property
    def spans(self) -> list[Span]:
        return [Span(self.uri, self.line)] if self.line is not None else []


class SchemaError(ValueError):
    def __init__(self, diagnostics: list[Diagnostic]) -> None:
        super().__init__("; ".join(f"{d.code}: {d.message}" for d in diagnostics[:5]))
        self.diagnostics = diagnostics


@dataclass
class Node:
    tag: str
    ns: str | None
    attrs: dict[str, str]
    scope: dict[str, str]
    line: int
    children: list[Node] = field(default_factory=list)
    text: str = ""
    parts: list = field(default_factory=list)  # texts and nodes in their order

    def get(self, name: str, default: str | None = None) -> str | None:
        v = self.attrs.get(name)
        return default if v is None else v.strip(" \t\r\n")

    def xs(self, *tags: str) -> list[Node]:
        return [c for c in self.children if c.ns == XSD and (not tags or c.tag in tags)]


def parse(data: bytes | str, uri: str, max_depth: int = 256, nodes_limit: int = 10_000_000) -> Node:
    """The element tree of a document, with lines and prefix scopes."""
    stack: list[Node] = []
    root: list[Node] = []
    scopes: list[dict[str, str]] = [{"xml": "http://www.w3.org/XML/1998/namespace"}]
    pending: dict[str, str] = {}
    count = 0
    p = expat.ParserCreate(namespace_separator=" ")
    p.buffer_text = True

    def ns(prefix: str | None, value: str | None) -> None:
        pending[prefix or ""] = value or ""

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal count
        count += 1
        scopes.append(scopes[-1] | pending)
        pending.clear()
        space, _, local = name.rpartition(" ")
        node = Node(local, space or None, {k.rpartition(" ")[2] if k.rpartition(" ")[0] == "" else "{" + k.replace(" ", "}"): v for k, v in attrs.items()}, scopes[-1], p.CurrentLineNumber)
        if len(stack) >= max_depth or count > nodes_limit:
            raise SchemaError([Diagnostic("XSD1001", "the document is nested too deeply or too large", uri=uri, line=node.line)])
        (stack[-1].children if stack else root).append(node)
        if stack:
            stack[-1].parts.append(node)
        stack.append(node)

    def end(_: str) -> None:
        stack.pop()
        scopes.pop()

    def text(data: str) -> None:
        if stack:
            stack[-1].text += data
            stack[-1].parts.append(data)

    p.StartNamespaceDeclHandler, p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = ns, start, end, text
    try:
        p.Parse(text_of(data) if isinstance(data, bytes) else data, True)
    except EncodingProblem as e:
        raise SchemaError([Diagnostic(e.code, str(e), uri=uri)]) from None
    except expat.ExpatError as e:
        raise SchemaError([Diagnostic("XSD1001", str(e), uri=uri, line=e.lineno)]) from None
    except (LookupError, ValueError) as e:
        if isinstance(e, SchemaError):
            raise
        raise SchemaError([Diagnostic("XSD1006", str(e), uri=uri)]) from None
    return root[0]


@dataclass
class Wildcard:
    mode: str = "any"  # any, not or in
    spaces: tuple[str | None, ...] = ()
    process: str = "strict"
    not_names: tuple[Name, ...] = ()
    deny: tuple[str, ...] = ()  # "defined", "sibling": names that have such a declaration

    def admits(self, name: Name) -> bool:
        if name in self.not_names:
            return False
        return self.mode == "any" or (name[0] in self.spaces) == (self.mode == "in")

    def column(self, ns: Column, local: Column | None = None) -> Column:
        """``admits`` of names in columns; a null namespace is none."""
        from pyspark.sql import functions as F

        ok = F.lit(True)
        if self.mode != "any":
            named = [x for x in self.spaces if x is not None]
            held = F.coalesce(ns.isin(named), F.lit(False)) if named else F.lit(False)
            held = held | ns.isNull() if None in self.spaces else held
            ok = held if self.mode == "in" else ~held
        for space, name in self.not_names if local is not None else ():
            ok = ok & ~((ns.isNull() if space is None else ns.eqNullSafe(F.lit(space))) & (local == name))
        return ok

    def union(self, other: Wildcard) -> Wildcard:
        a, b = set(self.spaces), set(other.spaces)
        if "any" in (self.mode, other.mode):
            mode, spaces = "any", set()
        elif self.mode == other.mode == "in":
            mode, spaces = "in", a | b
        elif self.mode == other.mode == "not":
            mode, spaces = "not", a & b
        else:
            mode, spaces = "not", (a - b if self.mode == "not" else b - a)
        return Wildcard(mode, tuple(sorted(spaces, key=str)), self.process, tuple(n for n in self.not_names if not other.admits(n)) + tuple(n for n in other.not_names if n not in self.not_names and not self.admits(n)), tuple(x for x in self.deny if x in other.deny))

    def intersect(self, other: Wildcard) -> Wildcard:
        a, b = set(self.spaces), set(other.spaces)
        if self.mode == "any":
            mode, spaces = other.mode, b
        elif other.mode == "any":
            mode, spaces = self.mode, a
        elif self.mode == other.mode:
            mode, spaces = self.mode, (a & b if self.mode == "in" else a | b)
        else:
            mode, spaces = "in", (a - b if self.mode == "in" else b - a)
        return Wildcard(mode, tuple(sorted(spaces, key=str)), self.process, tuple(dict.fromkeys(self.not_names + other.not_names)), tuple(dict.fromkeys(self.deny + other.deny)))

    def subset_of(self, other: Wildcard) -> bool:
        if other.mode == "any":
            return True
        if self.mode == "in":
            return all(other.admits((s, "")) for s in self.spaces)
        return self.mode == other.mode and set(other.spaces) <= set(self.spaces)


@dataclass
class Element:
    name: Name
    type: object = None  # Name of a global type, or an inline type
    nillable: bool = False
    abstract: bool = False
    default: str | None = None
    fixed: str | None = None
    heads: tuple[Name, ...] = ()
    keys: list[Identity] = field(default_factory=list)
    block: tuple[str, ...] = ()
    is_global: bool = False
    final: tuple[str, ...] = ()


@dataclass
class Attribute:
    name: Name
    type: object = None
    use: str = "optional"
    default: str | None = None
    fixed: str | None = None


@dataclass
class Particle:
    term: object  # Element, Name of an element, Wildcard, Group or GroupRef
    low: int = 1
    high: int = 1


@dataclass
class Group:
    kind: str  # sequence, choice or all
    items: list[Particle] = field(default_factory=list)


@dataclass
class GroupRef:
    name: Name


@dataclass
class Complex:
    name: Name | None
    base: object = None
    derivation: str = "restriction"
    content: str = "empty"  # empty, simple, elements or mixed
    particle: Particle | None = None
    attributes: list = field(default_factory=list)  # Attribute, or the Name of a group
    any_attribute: Wildcard | None = None
    simple: object = None  # the type of simple content
    abstract: bool = False
    block: tuple[str, ...] = ()
    final: tuple[str, ...] = ()
    open: tuple[str, Wildcard] | None = None


@dataclass
class Declared:
    """A simple type as written: resolved to ``Simple`` at compile time."""

    name: Name | None
    variety: str
    base: object = None
    item: object = None
    members: list = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    facets: dict[str, object] = field(default_factory=dict)
    final: tuple[str, ...] = ()
    line: int = 0


@dataclass
class Identity:
    kind: str  # unique, key or keyref
    name: Name
    selector: list[list[str]]
    fields: list[list[list[str]]]
    refer: Name | None = None


FACETS = ("length", "minLength", "maxLength", "enumeration", "whiteSpace", "minInclusive", "minExclusive", "maxInclusive", "maxExclusive", "totalDigits", "fractionDigits", "pattern", "explicitTimezone", "minScale", "maxScale", "assertion")


class SchemaSet:
    """Compiled components.  ``elements``, ``types``, ``attributes``, ``groups`` and ``attribute_groups`` are by name."""

    def __init__(self) -> None:
        self.version, self.conformance = "1.0", "strict"
        self.elements: dict[Name, Element] = {}
        self.types: dict[Name, object] = {(XSD, n): Simple(n, n) if not b.item else Simple("string", n, item=Simple(b.item, b.item), facets={"minLength": 1}) for n, b in BUILTINS.items()}
        anything = Complex((XSD, "anyType"), None, content="mixed", particle=Particle(Group("sequence", [Particle(Wildcard(process="lax"), 0, UNBOUNDED)])), any_attribute=Wildcard(process="lax"))
        self.types[(XSD, "anyType")] = anything
        self.attributes: dict[Name, Attribute] = {("http://www.w3.org/XML/1998/namespace", n): Attribute(("http://www.w3.org/XML/1998/namespace", n), (XSD, t)) for n, t in (("lang", "language"), ("space", "NCName"), ("base", "anyURI"), ("id", "ID"))}
        self.attributes |= {(XSI, n): Attribute((XSI, n), (XSD, t)) for n, t in (("type", "QName"), ("nil", "boolean"), ("schemaLocation", "anyURI"), ("noNamespaceSchemaLocation", "anyURI"))}
        self.simple_base: dict[str, list] = {}
        self.docs: dict[tuple[str, Name], dict] = {}  # documentation and appinfo of global components
        self.declared: dict[Name, tuple[dict, list[str]]] = {}  # facets and patterns of simple types' own steps
        self.groups: dict[Name, Group] = {}
        self.attribute_groups: dict[Name, tuple[list, Wildcard | None]] = {}
        self.notations: dict[Name, dict] = {}
        self.annotations: list[tuple[str, str]] = []
        self.documents: list[dict] = []
        self.diagnostics: list[Diagnostic] = []
        self.substitutes: dict[Name, list[Name]] = {}

    # -- building ---------------------------------------------------------------------------------

    @classmethod
    def load(cls, *sources: tuple[str | bytes, str], resolver: Callable[[str, str | None], tuple[str, bytes]] | None = None, version: str = "1.0", conformance: str = "strict", search_path: tuple[str, ...] = (), max_depth: int = 256, nodes_limit: int = 10_000_000) -> SchemaSet:
        """Of (content, uri) pairs; raises SchemaError on errors unless ``conformance`` is ``lax``."""
        from .loader import Loader

        out = cls()
        out.version, out.conformance = version, conformance
        loader = Loader(out, resolver or Files(search_path), max_depth, nodes_limit)
        for data, uri in sources:
            loader.document(data, uri, None)
        loader.finish()
        if conformance == "strict" and any(d.severity == "error" for d in out.diagnostics):
            raise SchemaError([d for d in out.diagnostics if d.severity == "error"])
        return out

    @classmethod
    def from_text(cls, text: str, uri: str = "memory:schema.xsd", **options) -> SchemaSet:
        return cls.load((text, uri), **options)

    @classmethod
    def from_file(cls, path: str, **options) -> SchemaSet:
        with open(path, "rb") as f:
            return cls.load((f.read(), path), **options)

    def serialize(self) -> bytes:
        return b"XYLEM" + bytes([VERSION]) + pickle.dumps({k: v for k, v in self.__dict__.items() if k != "_automata"})

    @classmethod
    def deserialize(cls, data: bytes) -> SchemaSet:
        """Of bytes that ``serialize`` of this version made; only for trusted bytes, as pickles can run code."""
        if data[:5] != b"XYLEM" or data[5:6] != bytes([VERSION]):
            raise ValueError("not a schema set of this version")
        out = cls()
        out.__dict__.update(pickle.loads(data[6:]))
        return out

    # -- questions --------------------------------------------------------------------------------

    def type_of(self, ref: object) -> object:
        if ref is None:
            return self.types[(XSD, "anyType")]
        return self.types.get(ref, self.types[(XSD, "anyType")]) if isinstance(ref, tuple) else ref

    def base_chain(self, t: object) -> list[object]:
        out, seen = [t], {id(t)}
        while isinstance(t, Complex) and t.base is not None:
            t = self.type_of(t.base)
            if id(t) in seen:
                break
            seen.add(id(t))
            out.append(t)
        if isinstance(t, Simple):
            for n in self._simple_bases(t):
                out.append(n)
        if out[-1] is not self.types[(XSD, "anyType")]:
            out.append(self.types[(XSD, "anyType")])
        return out

    def _simple_bases(self, t: Simple) -> list[object]:
        out = []
        for n in self.simple_base.get(id_of(t), []):
            if n in self.types:
                out.append(self.types[n])
        return out

    def derives_from(self, a: object, b: object) -> bool:
        """Whether type a is b or derived from it; a member of a union counts."""
        if any(x is b for x in self.base_chain(a)):
            return True
        if isinstance(a, Simple) and isinstance(b, Simple):
            if b.members:
                return any(self.derives_from(a, m) for m in b.members)
            from ..functions.builtins import ancestors

            return not b.patterns and not b.facets and b.builtin in ancestors(a.builtin) and not a.members and not a.item
        return False

    def derives_unblocked(self, a: object, b: object, block: tuple[str, ...]) -> bool:
        """Whether no step from type a to its base b is by a blocked method."""
        while a is not b and isinstance(a, Complex):
            if a.derivation in block:
                return False
            a = self.type_of(a.base)
        return a is b or "restriction" not in block

    def related(self, a: object, b: object) -> bool:
        """Whether one type is the other or derived from it."""
        return a is b or self.derives_from(a, b) or self.derives_from(b, a)

    def attributes_of(self, t: Complex) -> tuple[dict[Name, Attribute], Wildcard | None]:
        """Attribute uses in force, and the attribute wildcard; groups expanded, bases inherited."""
        uses: dict[Name, Attribute] = {}
        wild: Wildcard | None = None
        base = self.type_of(t.base) if t.base is not None else None
        if isinstance(base, Complex) and base is not t and base.name != (XSD, "anyType"):
            inherited, more = self.attributes_of(base)
            uses |= inherited
            wild = more if t.derivation == "extension" else None
        own, own_wild = self._expanded(t.attributes, t.any_attribute, set())
        uses |= own
        if own_wild:
            wild = own_wild.union(wild) if wild else own_wild
        return {n: a for n, a in uses.items() if a.use != "prohibited"}, wild

    def _expanded(self, items: list, wild: Wildcard | None, seen: set) -> tuple[dict[Name, Attribute], Wildcard | None]:
        out: dict[Name, Attribute] = {}
        for a in items:
            if isinstance(a, Attribute):
                out.setdefault(a.name, a)
            elif a not in seen and a in self.attribute_groups:
                inner, w = self._expanded(*self.attribute_groups[a], seen | {a})
                for n, x in inner.items():
                    out.setdefault(n, x)
                if w:
                    wild = wild.intersect(w) if wild else w
        return out, wild

    def particles_of(self, t: Complex) -> list[Particle]:
        base = self.type_of(t.base) if t.base is not None else None
        own = [t.particle] if t.particle else []
        if t.derivation == "extension" and isinstance(base, Complex) and base is not t:
            return self.particles_of(base) + own
        return own

    def mixed(self, t: Complex) -> bool:
        base = self.type_of(t.base) if t.base is not None else None
        return t.content == "mixed" or (t.derivation == "extension" and t.particle is None and isinstance(base, Complex) and base is not t and self.mixed(base))

    def simple_of(self, t: object) -> Simple | None:
        """The simple type that text has, if the type has simple content."""
        for _ in range(64):
            if isinstance(t, Simple):
                return t
            if not isinstance(t, Complex) or t.content != "simple":
                return None
            t = self.type_of(t.simple if t.simple is not None else t.base)
        return None

    def permitted(self, head: Name) -> list[Name]:
        """The elements that may stand for ``head``: itself unless abstract, and its substitution group."""
        e = self.elements.get(head)
        out = [] if e is not None and e.abstract else [head]
        if e is None or "substitution" in e.block:
            return out
        base = self.type_of(e.type)
        block = e.block + (base.block if isinstance(base, Complex) else ())
        return out + [m for m in self.substitutes.get(head, []) if not self.elements[m].abstract and self.derives_unblocked(self.type_of(self.elements[m].type), base, block)]


def id_of(t: Simple) -> str:
    return t.name or repr(t)


class Files:
    """Schema locations on local disk: next to the including document, then here, then the search path."""

    def __init__(self, search_path: tuple[str, ...] = ()) -> None:
        self.search_path = search_path

    def __call__(self, location: str, base: str | None) -> tuple[str, bytes]:
        if re.match(r"https?://", location):
            raise FileNotFoundError(location)
        location = location.removeprefix("file://")
        for folder in (os.path.dirname(base.removeprefix("file://")) if base else ".", ".", *self.search_path):
            path = os.path.abspath(os.path.join(folder, location))
            if os.path.isfile(path):
                with open(path, "rb") as f:
                    return path, f.read()
        raise FileNotFoundError(location)


def check_pattern(pattern: str) -> str | None:
    """What is wrong with a pattern: its grammar, or what an engine refuses (as a count above its bound)."""
    import regex

    try:
        translate(pattern)
        regex.compile("(?V1)" + translate(pattern, python=True))
    except PatternError as e:
        return str(e)
    except (regex.error, OverflowError) as e:
        return f"the engine refuses it: {e}"
    return None


__all__ = ["check_pattern", "unknown_blocks"]
