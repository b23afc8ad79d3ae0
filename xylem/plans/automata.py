"""Content models as position automata (Glushkov), and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from .schema import UNBOUNDED, Complex, Diagnostic, Element, Group, GroupRef, Name, Particle, SchemaSet, Wildcard

MOST_COPIES, MOST_POSITIONS = 64, 4096


@dataclass
class Automaton:
    """Positions admit an element (with its substitutes) or a wildcard.  ``all_`` models count members instead."""

    terms: list = field(default_factory=list)
    names: list[dict[Name, object]] = field(default_factory=list)  # of a position: the names it admits, with their declarations
    first: tuple[int, ...] = ()
    follow: list[tuple[int, ...]] = field(default_factory=list)
    last: frozenset[int] = frozenset()
    nullable: bool = True
    approximated: bool = False
    limits: list[tuple[int, int]] | None = None  # of xs:all: each position's occurrence

    def __post_init__(self) -> None:
        self.moves: dict = {}

    def start(self):
        return () if self.limits is None else tuple([0] * len(self.terms))

    def step(self, state, name: Name):
        """(next state, position) or None.  A state is the set of positions just matched; none at the start."""
        key = (state, name)
        if key not in self.moves:
            self.moves[key] = self._step(state, name)
        return self.moves[key]

    def _step(self, state, name: Name):
        if self.limits is not None:
            for i, (_, high) in enumerate(self.limits):
                if self.admits(i, name) and (high == UNBOUNDED or state[i] < high):
                    return (*state[:i], state[i] + 1, *state[i + 1 :]), i
            return None
        reach = self.first if state == () else sorted({q for p in state for q in self.follow[p]})
        hit = [q for q in reach if self.admits(q, name)]
        return (tuple(hit), min(hit, key=lambda q: (isinstance(self.terms[q], Wildcard), q))) if hit else None

    def admits(self, i: int, name: Name) -> bool:
        t = self.terms[i]
        return t.admits(name) if isinstance(t, Wildcard) else name in self.names[i]

    def accepts_end(self, state) -> bool:
        if self.limits is not None:
            return (self.nullable and not any(state)) or all(n >= low for n, (low, _) in zip(state, self.limits, strict=True))
        return self.nullable if state == () else any(p in self.last for p in state)

    def accepts(self, names: list[Name]) -> bool:
        state = self.start()
        for n in names:
            moved = self.step(state, n)
            if moved is None:
                return False
            state = moved[0]
        return self.accepts_end(state)


class _Builder:
    def __init__(self, schemas: SchemaSet) -> None:
        self.s, self.out = schemas, Automaton()
        self.follow: list[set[int]] = []
        self.path: list[Name] = []

    def position(self, term: object) -> tuple[set, set, bool]:
        self.out.terms.append(term)
        self.out.names.append({} if isinstance(term, Wildcard) else names_of(self.s, term))
        self.follow.append(set())
        i = len(self.follow) - 1
        return {i}, {i}, False

    def chain(self, a, b):
        for p in a[1]:
            self.follow[p] |= b[0]
        return a[0] | (b[0] if a[2] else set()), b[1] | (a[1] if b[2] else set()), a[2] and b[2]

    def once(self, term: object):
        if isinstance(term, GroupRef):
            if term.name in self.path:
                return set(), set(), True
            self.path.append(term.name)
            out = self.once(self.s.groups.get(term.name, Group("sequence")))
            self.path.pop()
            return out
        if not isinstance(term, Group):
            return self.position(term)
        parts = [self.particle(p) for p in term.items]
        if term.kind == "sequence":
            out = (set(), set(), True)
            for p in parts:
                out = self.chain(out, p)
            return out
        first, last = set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts))
        if term.kind == "all":  # nested: any order, any number
            self.out.approximated = True
            for p in last:
                self.follow[p] |= first
            return first, last, all(p[2] for p in parts)
        return first, last, not parts or any(p[2] for p in parts)

    def particle(self, p: Particle):
        if p.high == 0:
            return set(), set(), True
        if p.low > MOST_COPIES or p.high > MOST_COPIES or len(self.follow) > MOST_POSITIONS:
            self.out.approximated = True
            low, high = min(p.low, 1), UNBOUNDED
        else:
            low, high = p.low, p.high
        out = (set(), set(), True)
        for _ in range(low if high != UNBOUNDED else max(low - 1, 0)):
            out = self.chain(out, self.once(p.term))
        if high == UNBOUNDED:
            again = self.once(p.term)
            for q in again[1]:
                self.follow[q] |= again[0]
            return self.chain(out, (again[0], again[1], again[2] or low == 0))
        tail = None
        for _ in range(high - low):  # the optional copies, nested from the inside
            one = self.once(p.term)
            tail = (one[0], one[1], True) if tail is None else (lambda c: (c[0], c[1] | one[1], True))(self.chain(one, tail))
        return self.chain(out, tail) if tail else out


def names_of(s: SchemaSet, term: object) -> dict[Name, object]:
    """The names a term admits: a global element with its substitution group."""
    name = term if isinstance(term, tuple) else term.name
    if isinstance(term, Element) and not term.is_global:
        return {name: term}
    return {n: s.elements.get(n) for n in s.permitted(name)} or {name: s.elements.get(name)}


def automaton(s: SchemaSet, t: Complex) -> Automaton:
    kept = s.__dict__.setdefault("_automata", {})
    if id(t) in kept:
        return kept[id(t)]
    parts = s.particles_of(t)
    b = _Builder(s)
    lone = parts[0] if len(parts) == 1 else None
    term = s.groups.get(lone.term.name) if lone and isinstance(lone.term, GroupRef) else lone.term if lone else None
    if isinstance(term, Group) and term.kind == "all":
        for p in term.items:
            b.position(p.term)
        b.out.limits = [(p.low, p.high) for p in term.items]
        b.out.follow = [()] * len(term.items)
        b.out.nullable = lone.low == 0
    else:
        out = (set(), set(), True)
        for p in parts:
            out = b.chain(out, b.particle(p))
        b.out.first, b.out.last, b.out.nullable = tuple(sorted(out[0])), frozenset(out[1]), out[2]
        b.out.follow = [tuple(sorted(f)) for f in b.follow]
    kept[id(t)] = b.out
    return b.out


def check(s: SchemaSet, t: Complex) -> list[Diagnostic]:
    """Unique particle attribution: no name may go to two different particles from one state."""
    a = automaton(s, t)
    warn = "warning" if a.approximated or s.conformance == "lax" else "error"
    for state in [a.first if a.limits is None else range(len(a.terms)), *a.follow]:
        seen: dict[Name, int] = {}
        wild = [q for q in state if isinstance(a.terms[q], Wildcard)]
        for q in state:
            for n in a.names[q]:
                other = seen.setdefault(n, q)
                if a.terms[other] is not a.terms[q]:
                    return [Diagnostic("XSD1304", f"{t.name}: {n[1]} may be two particles", warn)]
                if s.version == "1.0" and any(a.terms[w].admits(n) for w in wild):
                    return [Diagnostic("XSD1304", f"{t.name}: {n[1]} may be an element or a wildcard's", warn)]
        for i, x in enumerate(wild):
            for y in wild[i + 1 :]:
                if a.terms[x] is not a.terms[y] and (both := a.terms[x].intersect(a.terms[y])) and (both.mode != "in" or both.spaces):
                    return [Diagnostic("XSD1304", f"{t.name}: two wildcards overlap", warn)]
    return []


def children(s: SchemaSet, t: Complex) -> list[tuple[Name, bool, bool]]:
    """(name, repeats, optional) of each possible child, in order of first appearance."""
    a = automaton(s, t)
    names = list(dict.fromkeys(n for m in a.names for n in m))
    if a.limits is not None:
        by = {n: [a.limits[i] for i, m in enumerate(a.names) if n in m] for n in names}
        return [(n, any(h == UNBOUNDED or h > 1 for _, h in v) or len(v) > 1, a.nullable or not any(low and len(m) == 1 for (low, _), m in zip(a.limits, a.names, strict=True) if n in m)) for n, v in by.items()]
    again = _cyclic(a)
    out = []
    for n in names:
        own = {i for i, m in enumerate(a.names) if n in m}
        forced = {i for i in own if len(a.names[i]) == 1}
        # optional: the end can be reached without a position that admits nothing else
        todo, seen = [p for p in a.first if p not in forced], set()
        optional = a.nullable
        while todo and not optional:
            p = todo.pop()
            if p in seen:
                continue
            seen.add(p)
            optional = p in a.last
            todo += [q for q in a.follow[p] if q not in forced]
        out.append((n, any(again[p] for p in own) or len(own) > 1 and _reaches(a, own), optional))
    return out


def _cyclic(a: Automaton) -> list[bool]:
    """Which positions can come again after themselves: those of a strongly connected component with a move inside."""
    n = len(a.follow)
    index, low, on, out, stack, count = [0] * n, [0] * n, [False] * n, [False] * n, [], 0
    for root in range(n):
        if index[root]:
            continue
        work = [(root, iter(a.follow[root]))]
        count += 1
        index[root] = low[root] = count
        stack.append(root)
        on[root] = True
        while work:
            p, ahead = work[-1]
            for q in ahead:
                if not index[q]:
                    count += 1
                    index[q] = low[q] = count
                    stack.append(q)
                    on[q] = True
                    work.append((q, iter(a.follow[q])))
                    break
                if on[q]:
                    low[p] = min(low[p], index[q])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[p])
                if low[p] == index[p]:
                    members = []
                    while True:
                        q = stack.pop()
                        on[q] = False
                        members.append(q)
                        if q == p:
                            break
                    if len(members) > 1 or p in a.follow[p]:
                        for q in members:
                            out[q] = True
    return out


def _reaches(a: Automaton, own: set[int]) -> bool:
    """Whether one of some positions leads to another of them."""
    todo, seen = [q for p in own for q in a.follow[p]], set()
    while todo:
        q = todo.pop()
        if q in own:
            return True
        if q not in seen:
            seen.add(q)
            todo += a.follow[q]
    return False
