"""One pass over one document in a Python worker: diagnostics, and what a sink makes of its elements.

What a schema says about an element in a place is gathered once, as a ``Plan``: its
type's compiled value checks, attribute uses, content model, and, filled as documents
come, the plan of each child name in each state.  A typical element then costs two
dictionary lookups and a remembered value.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa

from ..functions.builtins import XSD, XSI, ancestors
from ..functions.facets import Simple
from ..plans.automata import automaton
from ..plans.encodings import EncodingProblem, text_of
from ..plans.schema import Attribute, Complex, Element, Name, SchemaSet, Wildcard
from ..plans.values import compiled

DEEPEST = 10_000
_BLANK = " \t\r\n"
_NAMES = ("QName", "NOTATION")


class _Stop(Exception):
    pass


def clark(n: Name) -> str:
    return f"{{{n[0]}}}{n[1]}" if n[0] else n[1]


def _name(raw: str) -> Name:
    ns, _, local = raw.rpartition(" ")
    return ns or None, local


def _raw(n: Name) -> str:
    return f"{n[0]} {n[1]}" if n[0] else n[1]


def _marked(t: Simple) -> bool:
    """Whether values of the type say more than themselves: identifiers, references and names with prefixes."""
    if t.members:
        return any(map(_marked, t.members))
    names = ancestors((t.item or t).builtin) if not (t.item and t.item.members) else []
    return any(x in names for x in ("ID", "IDREF", "IDREFS", "ENTITY", "ENTITIES", "QName", "NOTATION")) or bool(t.item and t.item.members and _marked(t.item))


class Use:
    """One attribute of a plan."""

    __slots__ = ("attribute", "check", "clark", "fixed", "local", "marked")

    def __init__(self, s: SchemaSet, n: Name, a: Attribute) -> None:
        self.attribute, self.clark, self.local = a, clark(n), n[1]
        t = s.simple_of(s.type_of(a.type)) or Simple("anySimpleType")
        self.check, self.marked = compiled(t, s.version), _marked(t)
        self.fixed = None if a.fixed is None else self.check.look(a.fixed)[2]


class Plan:
    """All that holds for elements of one declaration and type."""

    __slots__ = ("check", "decl", "elementary", "fixed", "keys", "marked", "missing", "mixed", "model", "moves", "required", "siblings", "skip", "start", "supplied", "type", "type_name", "uses", "value", "wildcard")

    def __init__(self, s: SchemaSet, decl: Element | None, kind: object, skip: bool) -> None:
        self.decl, self.type, self.skip, self.moves = decl, kind, skip, {}
        self.check = self.model = self.wildcard = self.value = self.fixed = self.type_name = None
        self.uses: dict[str, Use] = {}
        self.mixed = self.marked = self.elementary = False
        self.start = ()
        self.keys = decl.keys if decl is not None else []
        self.siblings: dict[Name, Element] = {}
        if kind is not None:
            named = kind.name
            self.type_name = clark(named) if isinstance(named, tuple) else named
        if not skip and kind is not None:
            simple = s.simple_of(kind)
            if simple is not None:
                self.check, self.marked = compiled(simple, s.version), _marked(simple)
                if decl is not None:
                    self.value = decl.default if decl.default is not None else decl.fixed
                    self.fixed = None if decl.fixed is None else self.check.look(decl.fixed)[2]
            if isinstance(kind, Complex):
                uses, self.wildcard = s.attributes_of(kind)
                self.uses = {_raw(n): Use(s, n, a) for n, a in uses.items()}
                self.model = automaton(s, kind)
                self.start, self.mixed = self.model.start(), simple is None and s.mixed(kind)
                self.elementary = simple is None and not self.mixed
                if any(isinstance(t, Wildcard) for t in self.model.terms) or kind.open:
                    self.siblings = {n: e for names in self.model.names for n, e in names.items() if e is not None}
        self.required = [r for r, u in self.uses.items() if u.attribute.use == "required"]
        self.supplied = [(r, u, v) for r, u in self.uses.items() if u.attribute.use != "required" and (v := u.attribute.default if u.attribute.default is not None else u.attribute.fixed) is not None]
        self.missing = bool(self.required or self.supplied)


class _Frame:
    __slots__ = ("attributes", "kids", "line", "nil", "node", "path", "plan", "raw", "seq", "state", "text")

    def __init__(self, plan: Plan, raw: str) -> None:
        self.plan, self.raw, self.state, self.text, self.kids, self.nil, self.attributes, self.seq, self.path, self.line, self.node = plan, raw, plan.start, None, False, False, (), 0, 0, 0, None


class Validator:
    """``run`` gives the diagnostics of a document, as (code, message, line, severity); a sink gets its elements."""

    def __init__(self, schemas: SchemaSet, sink: Events | Rows | None = None) -> None:
        self.s, self.sink = schemas, sink
        self.plans: dict[tuple, Plan] = {}
        self.roots: dict[str, Plan] = {}
        #: Names from the root, as (path of the parent, name) in order of first appearance.
        self.paths: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[str, ...]] = [()]
        self.anything = self.plan(None, schemas.types[(XSD, "anyType")], False)
        self.skipped = self.plan(None, None, True)

    def plan(self, decl: Element | None, kind: object, skip: bool) -> Plan:
        k = (id(decl), id(kind), skip)
        got = self.plans.get(k)
        if got is None:
            got = self.plans[k] = Plan(self.s, decl, kind, skip)
        return got

    def declared(self, decl: Element) -> Plan:
        return self.plan(decl, self.s.type_of(decl.type), False)

    def path(self, parent: int, raw: str) -> int:
        got = self.paths.get((parent, raw))
        if got is None:
            got = self.paths[(parent, raw)] = len(self.steps)
            self.steps.append((*self.steps[parent], clark(_name(raw))))
        return got

    def run(self, data: str | bytes | None) -> list[tuple]:
        for _ in self.stream(data, None):
            pass
        return self.diags

    def stream(self, data: str | bytes | None, size: int | None = 1 << 16) -> Iterator[bool]:
        """Reads a document in pieces of ``size``, and stops between them."""
        self.diags: list[tuple] = []
        self.stack: list[_Frame] = []
        self.scopes: list[tuple[int, dict]] = [(-1, {"xml": "http://www.w3.org/XML/1998/namespace"})]
        self.pending: dict = {}
        self.ids: dict[str, int] = {}
        self.refs: list[tuple[str, int]] = []
        self.entities: set[str] = set()
        self.open: list = []
        self.seq = 0
        p = self.p = expat.ParserCreate(namespace_separator=" ")
        p.buffer_text = p.ordered_attributes = True
        p.StartNamespaceDeclHandler = lambda prefix, uri: self.pending.__setitem__(prefix or "", uri or "")
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.chars
        p.UnparsedEntityDeclHandler = lambda name, *_: self.entities.add(name)
        p.EntityDeclHandler = self.entity
        try:
            if isinstance(data, bytes):
                data = text_of(data)
            if size is not None and data:
                for lo in range(0, len(data), size):
                    p.Parse(data[lo : lo + size], False)
                    yield True
                data = ""
            p.Parse(data if data is not None else "", True)
        except EncodingProblem as e:
            self.diags.append((e.code, str(e), None, "error"))
        except expat.ExpatError as e:
            self.diags.append(("XSD1001", str(e), e.lineno, "error"))
        except _Stop:
            pass
        else:
            for ref, line in self.refs:
                if ref not in self.ids:
                    self.say("XSD2012", f"no ID {ref}", line)

    def entity(self, name, is_parameter, value, *_rest) -> None:
        if value is not None and not is_parameter:  # own entities are not expanded
            self.diags.append(("XSD1001", f"the entity {name} is declared inside", self.p.CurrentLineNumber, "error"))
            raise _Stop

    def say(self, code: str, message: str, line: int | None = None) -> None:
        self.diags.append((code, message, line if line is not None else self.p.CurrentLineNumber, "error"))

    # -- the three callbacks --------------------------------------------------------------------------

    def start(self, raw: str, attrs: list[str]) -> None:
        stack = self.stack
        if self.pending:
            self.scopes.append((len(stack), self.scopes[-1][1] | self.pending))
            self.pending = {}
        if stack:
            top = stack[-1]
            top.kids = True
            moved = top.plan.moves.get((top.state, raw))
            if moved is None:
                moved = self.move(top, raw)
            top.state, plan = moved
            if len(stack) >= DEEPEST:
                self.say("XSD1001", "nested too deeply")
                raise _Stop
        else:
            top, plan = None, self.roots.get(raw) or self.root(raw)
        f = _Frame(plan, raw)
        f.seq = self.seq
        self.seq += 1
        if attrs:
            self.attributes(f, attrs)
            plan = f.plan
        elif plan.missing:
            self.absent(f, ())
        if plan.decl is not None and plan.decl.abstract:
            self.say("XSD2013", f"{_name(raw)[1]} is abstract")
        if plan.model is not None and plan.type.abstract:
            self.say("XSD2010", f"the type of {_name(raw)[1]} is abstract")
        stack.append(f)
        if self.sink is not None:
            self.sink.start(self, f, top)
        if self.open or plan.keys:
            self.identity_start(f, top)

    def chars(self, data: str) -> None:
        if self.stack:
            f = self.stack[-1]
            f.text = data if f.text is None else f.text + data

    def end(self, _: str) -> None:
        f = self.stack[-1]
        plan, text = f.plan, f.text
        lexical = canon = key = None
        supplied = False
        if not plan.skip:
            if f.nil:
                if f.kids or text:
                    self.say("XSD2009", f"{_name(f.raw)[1]} is nil but not empty")
            elif plan.check is not None:
                lexical = text or ""
                if not lexical and not f.kids and plan.value is not None:
                    lexical, supplied = plan.value, True
                why, canon, key, own = plan.check.look(lexical)
                if why is not None or plan.marked and not self.marks(lexical, own, _name(f.raw)[1], f.seq):
                    if why is not None:
                        self.say("XSD2004", f"{_name(f.raw)[1]}: {lexical[:60]!r} fails {why}")
                    canon = key = None
                elif plan.marked and own.builtin in _NAMES and not own.item:
                    canon, key = self.spelled(canon)
                elif plan.fixed is not None and key != plan.fixed:
                    self.say("XSD2004", f"{_name(f.raw)[1]} is fixed to {plan.decl.fixed}")
            elif plan.model is not None:
                if plan.mixed:
                    lexical = text or None
                elif text and (text.strip(_BLANK) or plan.type.content == "empty" and not plan.model.terms):
                    self.say("XSD2007", f"text in {_name(f.raw)[1]}")
                if not plan.model.accepts_end(f.state):
                    self.say("XSD2003", f"{_name(f.raw)[1]} is incomplete")
        if self.sink is not None:
            self.sink.end(self, f, lexical, canon, supplied)
        if self.open:
            self.identity_end(f, key)
        self.stack.pop()
        if self.scopes[-1][0] == len(self.stack):
            self.scopes.pop()

    # -- which declaration ----------------------------------------------------------------------------

    def root(self, raw: str) -> Plan:
        full = _name(raw)
        e = self.s.elements.get(full)
        if e is None:
            self.say("XSD2001", f"{full[1]} is not declared")
            return self.skipped
        got = self.roots[raw] = self.declared(e)
        return got

    def move(self, top: _Frame, raw: str) -> tuple[object, Plan]:
        """(the parent's next state, the child's plan); remembered where it says nothing."""
        before = len(self.diags)
        out = self._move(top, _name(raw))
        if len(self.diags) == before:
            top.plan.moves[(top.state, raw)] = out
        return out

    def _move(self, top: _Frame, full: Name) -> tuple[object, Plan]:
        plan, state = top.plan, top.state
        if plan.skip:
            return state, self.skipped
        if plan.model is None or plan.check is not None:
            self.say("XSD2002", f"{full[1]} in simple content")
            return state, self.skipped
        moved = plan.model.step(state, full)
        if moved is None:
            o = plan.type.open
            if o and self.admits(o[1], full, plan) and (o[0] == "interleave" or plan.model.accepts_end(state)):
                return state, self.wild(o[1], full, plan)
            self.say("XSD2002", f"{full[1]} is not expected in {_name(top.raw)[1]}")
            e = self.s.elements.get(full)
            return state, self.declared(e) if e is not None else self.skipped
        state, at = moved
        term = plan.model.terms[at]
        if isinstance(term, Wildcard):
            return state, self.wild(term, full, plan)
        e = plan.model.names[at].get(full)
        return state, self.declared(e) if e is not None else self.skipped

    def admits(self, w: Wildcard, full: Name, plan: Plan) -> bool:
        return w.admits(full) and not ("sibling" in w.deny and full in plan.siblings) and not ("defined" in w.deny and full in self.s.elements)

    def wild(self, w: Wildcard, full: Name, plan: Plan) -> Plan:
        if w.process == "skip":
            return self.skipped
        e, near = self.s.elements.get(full), plan.siblings.get(full)
        if e is not None and near is not None and not self.s.related(self.s.type_of(e.type), self.s.type_of(near.type)):
            self.say("XSD2018", f"{full[1]} has two types in one content model")
            return self.skipped
        e = near or e
        if e is not None:
            return self.declared(e)
        if w.process == "strict":
            self.say("XSD2001", f"{full[1]} is not declared")
            return self.skipped
        return self.anything

    # -- attributes and values ------------------------------------------------------------------------

    def attributes(self, f: _Frame, attrs: list[str]) -> None:
        names = attrs[::2]
        if any(n.startswith(XSI) for n in names):
            self.xsi(f, dict(zip(names, attrs[1::2], strict=True)))
        plan = f.plan
        if plan.skip:
            return
        out = []
        for n, v in zip(names, attrs[1::2], strict=True):
            use = plan.uses.get(n)
            if use is None:
                if not n.startswith(XSI + " "):
                    self.loose(f, n, v, out)
                continue
            why, canon, key, own = use.check.look(v)
            if why is not None:
                self.say("XSD2004", f"the attribute {use.local}: {v[:60]!r} fails {why}")
                canon = key = None
            elif use.marked and not self.marks(v, own, f"the attribute {use.local}", f.seq):
                canon = key = None
            elif use.marked and own.builtin in _NAMES and not own.item:
                canon, key = self.spelled(canon)
            elif use.fixed is not None and key != use.fixed:
                self.say("XSD2004", f"the attribute {use.local} is fixed to {use.attribute.fixed}")
            out.append((use.clark, v, canon, key, False))
        f.attributes = out
        if plan.missing:
            self.absent(f, names)

    def loose(self, f: _Frame, n: str, v: str, out: list) -> None:
        """An attribute that the type does not name."""
        full, w = _name(n), f.plan.wildcard
        known = self.s.attributes.get(full)
        if w is None or not w.admits(full) or "defined" in w.deny and known is not None:
            self.say("XSD2005", f"the attribute {full[1]} is not allowed on {_name(f.raw)[1]}")
        elif w.process != "skip" and known is not None:
            use = Use(self.s, full, known)
            why, canon, key, own = use.check.look(v)
            if why is not None or use.marked and not self.marks(v, own, f"the attribute {use.local}", f.seq):
                if why is not None:
                    self.say("XSD2004", f"the attribute {use.local}: {v[:60]!r} fails {why}")
                canon = key = None
            out.append((use.clark, v, canon, key, False))
        else:
            if w.process == "strict":
                self.say("XSD2005", f"the attribute {full[1]} is not declared")
            out.append((clark(full), v, v, ("string", v), False))

    def absent(self, f: _Frame, names) -> None:
        for r in f.plan.required:
            if r not in names:
                self.say("XSD2006", f"the attribute {f.plan.uses[r].local} is missing on {_name(f.raw)[1]}")
        more = []
        for r, use, v in f.plan.supplied:
            if r not in names:
                _, canon, key, _ = use.check.look(v)
                more.append((use.clark, v, canon, key, True))
        if more:
            f.attributes = [*f.attributes, *more]

    def xsi(self, f: _Frame, own: dict[str, str]) -> None:
        plan, local = f.plan, _name(f.raw)[1]
        kind = own.get(XSI + " type")
        if kind is not None:
            prefix, _, name = kind.strip(_BLANK).rpartition(":")
            t = self.s.types.get((self.scopes[-1][1].get(prefix) or None, name))
            block = (plan.decl.block if plan.decl is not None else ()) + (plan.type.block if isinstance(plan.type, Complex) else ())
            if t is None or plan.type is not None and not self.s.derives_from(t, plan.type) or plan.type is not None and not self.s.derives_unblocked(t, plan.type, block):
                self.say("XSD2008", f"xsi:type {kind}")
            else:
                plan = f.plan = self.plan(plan.decl, t, False)
                f.state = plan.start
        nil = own.get(XSI + " nil")
        if nil is not None and plan.decl is not None:
            nil = nil.strip(_BLANK)
            if nil not in ("true", "false", "1", "0"):
                self.say("XSD2004", f"xsi:nil is {nil}")
            elif not plan.decl.nillable or plan.decl.fixed is not None and nil in ("true", "1"):
                self.say("XSD2019", f"{local} can't be nil")
            else:
                f.nil = nil in ("true", "1")

    def spelled(self, v: str) -> tuple[str, object]:
        """A name's canonical form is its Clark form: prefixes are no part of the value."""
        prefix, _, local = v.rpartition(":")
        out = clark((self.scopes[-1][1].get(prefix) or None, local))
        return out, ("QName", out)

    def marks(self, v: str, t: Simple, what: str, owner: int) -> bool:
        """Records identifiers and references; false for a name with an unknown prefix."""
        kind = t.item.builtin if t.item else t.builtin
        names = ancestors(kind)
        for token in v.split():
            if "ID" in names:
                if self.ids.setdefault(token, owner) != owner:
                    self.say("XSD2011", f"the ID {token} comes twice")
            elif "IDREF" in names or kind == "IDREFS":
                self.refs.append((token, self.p.CurrentLineNumber))
            elif ("ENTITY" in names or kind == "ENTITIES") and token not in self.entities:
                self.say("XSD2017", f"no entity {token}")
            elif kind in ("QName", "NOTATION") and ":" in token and token.split(":")[0] not in self.scopes[-1][1]:
                self.say("XSD2004", f"{what}: the prefix of {token} is not bound")
                return False
        return True

    # -- keys -----------------------------------------------------------------------------------------

    @staticmethod
    def fits(alternatives: list[list[str]], path: tuple[str, ...]) -> bool:
        def one(steps: list[str], names: tuple[str, ...]) -> bool:
            if steps and steps[0] == "**":
                return any(one(steps[1:], names[i:]) for i in range(len(names) + 1))
            return len(steps) == len(names) and all(s in ("*", n) or s.endswith("}*") and n.startswith(s[:-1]) for s, n in zip(steps, names, strict=True))

        return any(one(s, path) for s in alternatives)

    def _path(self, f: _Frame) -> tuple[str, ...]:
        if not f.path:
            at = 0
            for x in self.stack:
                at = self.path(at, x.raw)
                if x is f:
                    break
            f.path = at
        return self.steps[f.path]

    def identity_start(self, f: _Frame, parent: _Frame | None) -> None:
        depth_ = len(self.stack)
        for c in f.plan.keys:
            self.open.append((c, depth_, []))
        path = self._path(f)
        for c, depth, rows in self.open:
            if self.fits(c.selector, path[depth:]):
                rows.append([depth_, [None] * len(c.fields), self.p.CurrentLineNumber])
            for row in rows:
                if row[0] <= depth_:
                    inner = path[row[0] :]
                    for i, alt in enumerate(c.fields):
                        for steps in alt:
                            if steps and steps[-1].startswith("@") and self.fits([steps[:-1]], inner):
                                v = next((a[3] for a in f.attributes if a[0] == steps[-1][1:] or steps[-1] == "@*"), None)
                                row[1][i] = v if v is not None else row[1][i]

    def identity_end(self, f: _Frame, key: object) -> None:
        here = len(self.stack)
        path = self._path(f)
        for c, _, rows in self.open:
            for row in rows:
                if row[0] <= here and key is not None:
                    for i, alt in enumerate(c.fields):
                        if any(not (s and s[-1].startswith("@")) and self.fits([s], path[row[0] :]) for s in alt):
                            row[1][i] = key
                if row[0] == here:
                    row[0] = 1 << 30  # closed
        ended = [x for x in self.open if x[1] == here]
        self.open = [x for x in self.open if x[1] != here]
        keys: dict[Name, set] = {}
        for c, _, rows in ended:
            if c.kind == "keyref":
                continue
            seen = keys.setdefault(c.name, set())
            for _, row, line in rows:
                if None in row:
                    if c.kind == "key":
                        self.say("XSD2015", f"the key {c.name[1]} lacks a field", line)
                elif tuple(row) in seen:
                    self.say("XSD2014", f"{c.name[1]}: {[x[1] for x in row]} comes twice", line)
                seen.add(tuple(row))
        for c, _, rows in ended:
            if c.kind == "keyref":
                for _, row, line in rows:
                    if None not in row and tuple(row) not in keys.get(c.refer, ()):
                        self.say("XSD2016", f"{c.name[1]}: no key {[x[1] for x in row]}", line)


# -- sinks --------------------------------------------------------------------------------------------


class Events:
    """Collects typed events as columns.  ``most`` ends a document's parse after so many events."""

    NAMES = ("seq", "depth", "kind", "path", "ns", "local", "type", "nil", "attributes", "lexical", "canonical", "from_schema", "line", "parent_seq", "declared")

    def __init__(self, wanted: tuple[str, ...] = NAMES, most: int | None = None) -> None:
        self.wanted, self.most = wanted, most
        self.lined, self.left = "line" in wanted, most
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []

    def document(self) -> None:
        self.left = self.most

    def put(self, v: Validator, row: tuple) -> None:
        if self.left is not None:
            if not self.left:
                raise _Stop
            self.left -= 1
        self.rows.append(row)

    def start(self, v: Validator, f: _Frame, parent: _Frame | None) -> None:
        f.path = v.paths.get((parent.path if parent else 0, f.raw)) or v.path(parent.path if parent else 0, f.raw)
        f.line = v.p.CurrentLineNumber if self.lined else 0
        self.put(v, (f.seq, len(v.stack) - 1, "start", f.path, f.raw, f.plan.type_name, f.nil, f.attributes, None, None, False, f.line, parent.seq if parent else None, f.plan.decl is not None))

    def end(self, v: Validator, f: _Frame, lexical: str | None, canon: str | None, supplied: bool) -> None:
        line = v.p.CurrentLineNumber if self.lined else 0
        depth = len(v.stack) - 1
        if lexical is not None:
            self.put(v, (v.seq, depth, "text", f.path, f.raw, None, f.nil, (), lexical, canon, supplied, line, f.seq, f.plan.decl is not None))
            v.seq += 1
        self.put(v, (v.seq, depth, "end", f.path, f.raw, None, f.nil, (), None, None, False, line, f.seq, f.plan.decl is not None))
        v.seq += 1

    def arrays(self, v: Validator) -> dict[str, pa.Array]:
        n = len(self.rows)
        cols = list(zip(*self.rows, strict=True)) if n else [()] * 14
        raw = dict(zip(("seq", "depth", "kind", "path", "raw", "type", "nil", "attributes", "lexical", "canonical", "from_schema", "line", "parent_seq", "declared"), cols, strict=True))
        out = {}
        for name in self.wanted:
            if name == "path":
                table = pa.array(v.steps, pa.list_(pa.string()))
                out[name] = table.take(pa.array(raw["path"], pa.int32()))
            elif name in ("ns", "local"):
                known: dict[str, int] = {}
                index = pa.array([known.setdefault(x, len(known)) for x in raw["raw"]], pa.int32())
                out[name] = pa.array([_name(x)[name == "local"] for x in known], pa.string()).take(index)
            elif name == "attributes":
                flat = [a for x in raw["attributes"] for a in x]
                ends = [0]
                for x in raw["attributes"]:
                    ends.append(ends[-1] + len(x))
                parts = list(zip(*flat, strict=True)) or [()] * 5
                inner = pa.StructArray.from_arrays([pa.array(parts[0], pa.string()), pa.array(parts[1], pa.string()), pa.array(parts[2], pa.string()), pa.array(parts[4], pa.bool_())], ["name", "lexical", "canonical", "from_schema"])
                out[name] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)
            else:
                kind = {"seq": pa.int64(), "depth": pa.int32(), "nil": pa.bool_(), "from_schema": pa.bool_(), "line": pa.int32(), "parent_seq": pa.int64(), "declared": pa.bool_()}.get(name, pa.string())
                out[name] = pa.array(raw[name], kind)
        return out

    def tree(self, v: Validator) -> list[dict]:
        """The events as dictionaries, for single documents."""
        got = self.arrays(v)
        return [dict(zip(got, x, strict=True)) for x in zip(*(c.to_pylist() for c in got.values()), strict=True)]


class Shape:
    """Where an element's decoded row goes: columns of one struct, a scalar, or JSON text where the schema has no bound."""

    def __init__(self, kind: str) -> None:
        self.kind = kind  # struct, scalar or raw
        self.attributes: dict[str, int] = {}
        self.children: dict[str, tuple[int, Shape, bool]] = {}
        self.text: int | None = None
        self.extra: int | None = None
        self.names: list[str] = []
        self.kinds: list[str] = []  # Spark types
        self.clear()

    def field(self, name: str, kind: str) -> int:
        self.names.append(name)
        self.kinds.append(kind)
        self.cols.append([])
        return len(self.names) - 1

    def plain(self) -> str:
        """The Spark type with text for every value."""
        if self.kind != "struct":
            return "string"
        own = {at: f"array<{s.plain()}>" if repeats else s.plain() for at, s, repeats in self.children.values()}
        own |= {self.extra: self.kinds[self.extra]} if self.extra is not None else {}
        return "struct<" + ",".join(f"`{n}`:{own.get(i, 'string')}" for i, n in enumerate(self.names)) + ">"

    def spark(self) -> str:
        return "struct<" + ",".join(f"`{n}`:{k}" for n, k in zip(self.names, self.kinds, strict=True)) + ">" if self.kind == "struct" else "string"

    def clear(self) -> None:
        self.cols: list[list] = [[] for _ in self.names]
        self.values: list = []  # of a scalar that repeats
        self.n = 0
        for _, s, _ in self.children.values():
            s.clear()

    def row(self) -> int:
        cols = self.cols
        for c in cols:
            c.append(None)
        for at, s, repeats in self.children.values():
            if repeats:
                cols[at][-1] = len(s.values) if s.kind != "struct" else s.n
        self.n += 1
        return self.n - 1

    def array(self) -> pa.Array:
        """The struct's rows; all values are canonical text."""
        own = {at: (s, repeats) for at, s, repeats in self.children.values()}
        out = []
        for i, c in enumerate(self.cols):
            if i not in own:
                out.append(_extras(c) if i == self.extra else pa.array(c, pa.string()))
                continue
            s, repeats = own[i]
            inner = s.array() if s.kind == "struct" else None
            if repeats:
                values = inner if inner is not None else pa.array(s.values, pa.string())
                out.append(pa.ListArray.from_arrays(pa.array([*c, len(values)], pa.int32()), values))
            else:
                out.append(inner.take(pa.array(c, pa.int32())) if inner is not None else pa.array(c, pa.string()))
        return pa.StructArray.from_arrays(out, self.names)


def _extras(rows: list) -> pa.Array:
    return pa.array([None if x is None else list(x.items()) for x in rows], pa.map_(pa.string(), pa.list_(pa.string())))


class Rows:
    """Folds documents of one root into the columns of a ``Shape``."""

    def __init__(self, root: str, shape: Shape) -> None:
        self.root, self.shape = root, shape
        self.clear()

    def clear(self) -> None:
        self.shape.clear()
        self.found: list = []  # by document: the root's row, or its scalar

    def document(self) -> None:
        self.found.append(None)

    def start(self, v: Validator, f: _Frame, parent: _Frame | None) -> None:
        if parent is None:
            shape = self.shape if f.raw == self.root else None
        elif parent.node is None:
            return
        elif isinstance(parent.node[1], dict):
            shape = _RAW
        else:
            got = parent.node[0].children.get(f.raw)
            shape = got[1] if got is not None else _RAW if parent.node[0].extra is not None else None
        if shape is None:
            return
        if shape.kind == "struct":
            at = shape.row()
            f.node = (shape, at)
            for a in f.attributes:
                i = shape.attributes.get(a[0])
                if i is not None:
                    shape.cols[i][-1] = a[2]
        elif shape.kind == "raw":
            f.node = (shape, {"@" + a[0].rpartition("}")[2]: a[2] for a in f.attributes})
        else:
            f.node = (shape, None)

    def end(self, v: Validator, f: _Frame, lexical: str | None, canon: str | None, supplied: bool) -> None:
        if f.node is None:
            return
        shape, at = f.node
        text = canon if canon is not None else lexical
        if shape.kind == "struct":
            if shape.text is not None:
                shape.cols[shape.text][-1] = text
            done = None if f.nil else at
        elif shape.kind == "raw":
            if text is not None:
                at["$"] = text
            done = None if f.nil else at if len(at) > 1 or "$" not in at else text
        else:
            done = text
        if len(v.stack) == 1:
            self.found[-1] = json.dumps(done) if shape.kind == "raw" else done
            return
        up, row = v.stack[-2].node
        if isinstance(row, dict):  # in JSON: a list from the second child of a name on
            name = _name(f.raw)[1]
            if name in row:
                row[name] = [*row[name], done] if isinstance(row[name], list) else [row[name], done]
            else:
                row[name] = done
            return
        got = up.children.get(f.raw)
        if got is None:
            extra = up.cols[up.extra]
            extra[-1] = extra[-1] or {}
            extra[-1].setdefault(clark(_name(f.raw)), []).append(json.dumps(done))
            return
        i, own, repeats = got
        if own.kind == "raw":
            done = json.dumps(done)
        if not repeats:
            up.cols[i][-1] = done
        elif own.kind != "struct":
            own.values.append(done)


_RAW = Shape("raw")
