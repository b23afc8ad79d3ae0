"""Reading schema documents into components, resolving references, and static rules."""

from __future__ import annotations

from ..functions.builtins import BUILTINS, XSD
from ..functions.facets import Simple
from . import rules
from .schema import (
    FACETS, UNBOUNDED, Attribute, Complex, Declared, Diagnostic, Element, Group, GroupRef, Identity, Name, Node, Particle, SchemaError, SchemaSet, Wildcard, check_pattern, id_of, parse, unknown_blocks,
)

TOP = {"element": "elements", "attribute": "attributes", "complexType": "types", "simpleType": "types", "group": "groups", "attributeGroup": "attribute_groups", "notation": "notations"}
_COMPOSE = ("include", "import", "redefine", "override")


class Loader:
    def __init__(self, out: SchemaSet, resolver, max_depth: int, nodes_limit: int) -> None:
        self.out, self.resolver, self.max_depth, self.nodes_limit = out, resolver, max_depth, nodes_limit
        self.seen: set[tuple[str, str | None]] = set()
        self.refs: list[tuple[str, Name, str, int]] = []
        self.idents: dict[Name, Identity] = {}

    def say(self, code: str, message: str, node: Node | None = None, severity: str = "error") -> None:
        self.out.diagnostics.append(Diagnostic(code, message, severity, getattr(self, "uri", None), node.line if node else None))

    # -- documents ----------------------------------------------------------------------------------

    def document(self, data: str | bytes, uri: str, chameleon: str | None, expected: str | None = None, how: str = "", replace: dict | None = None) -> None:
        try:
            root = parse(data, uri, self.max_depth, self.nodes_limit)
        except SchemaError as e:
            self.out.diagnostics += e.diagnostics
            return
        if (root.ns, root.tag) != (XSD, "schema"):
            self.out.diagnostics.append(Diagnostic("XSD1002", "the root is not xs:schema", uri=uri, line=root.line))
            return
        if not rules.included(root, self.out.version):
            root.children = []
        rules.prune(root, self.out.version)
        for code, message, node, severity in rules.written(root, self.out.version):
            self.out.diagnostics.append(Diagnostic(code, message, severity, uri, node.line))
        target = root.get("targetNamespace")
        if how == "import" and target != expected:
            self.out.diagnostics.append(Diagnostic("XSD1103", f"{uri} has the namespace {target}", uri=uri, line=root.line))
        if how in ("include", "redefine", "override") and target is not None and target != chameleon:
            self.out.diagnostics.append(Diagnostic("XSD1102", f"{uri} has the namespace {target}", uri=uri, line=root.line))
            return
        absorbed = target is None and chameleon is not None
        target = target or chameleon
        if (uri, target) in self.seen and not replace:
            return
        self.seen.add((uri, target))
        before = getattr(self, "uri", None), getattr(self, "target", None), getattr(self, "root", None), getattr(self, "absorbed", False), getattr(self, "opened", None), getattr(self, "given", None)
        self.uri, self.target, self.root, self.absorbed, self.opened, self.given = uri, target, root, absorbed, None, None
        if self.out.version == "1.1":
            if root.get("defaultAttributes"):
                self.given = self.name(root, root.get("defaultAttributes"), "attribute_groups")
            for c in root.xs("defaultOpenContent"):
                if c.xs("any"):
                    self.opened = (c.get("mode", "interleave"), self.wildcard(c.xs("any")[0]), c.get("appliesToEmpty") in ("true", "1"))
        self.out.documents.append({"uri": uri, "target_ns": target, "chameleon": absorbed, "version": root.get("version")})
        for c in root.xs(*_COMPOSE):
            self.compose(c)
        body = False
        for c in root.xs():
            if c.tag in ("annotation",):
                self.annotation(c, "schema")
            elif c.tag in TOP:
                body = True
                self.top(c, replace or {})
            elif c.tag in _COMPOSE:
                if body:
                    self.say("XSD1003", f"xs:{c.tag} after a declaration", c)
            elif c.tag not in ("defaultOpenContent",) and c.tag in rules.KNOWN:
                self.say("XSD1003", f"xs:{c.tag} is no schema element here", c)
        self.uri, self.target, self.root, self.absorbed, self.opened, self.given = before

    def compose(self, c: Node) -> None:
        place = c.get("schemaLocation")
        if place is None:
            if c.tag != "import":
                self.say("XSD1004", f"xs:{c.tag} without a schemaLocation", c)
            return
        try:
            uri, data = self.resolver(place, self.uri)
        except Exception as e:  # noqa: BLE001 - a resolver is the caller's code
            self.say("XSD1101", f"{place}: {e}", c, "warning" if c.tag == "import" else "error")
            return
        if c.tag == "import":
            self.document(data, uri, None, c.get("namespace"), "import")
            return
        replace = {(n.tag, n.get("name")): n for n in c.xs(*TOP)} if c.tag in ("override", "redefine") else None
        self.redefining = c.tag == "redefine"
        self.document(data, uri, self.target, None, c.tag, replace if c.tag == "override" else None)
        if c.tag == "redefine":
            for n in c.xs(*TOP):
                if n.tag in ("simpleType", "complexType", "group", "attributeGroup"):
                    self.redefine(n)
                else:
                    self.say("XSD1003", f"xs:{n.tag} can't be redefined", n)

    def redefine(self, n: Node) -> None:
        """The new component takes the name; its references to itself mean the old one, which gets a name of its own."""
        name, space = (self.target, n.get("name")), getattr(self.out, TOP[n.tag])
        old = space.pop(name, None)
        if old is None:
            self.say("XSD1201", f"{name[1]} is redefined and not defined", n)
        elif isinstance(old, Complex) != (n.tag == "complexType") and n.tag in ("simpleType", "complexType"):
            self.say("XSD1003", f"{name[1]} is redefined as another kind", n)
        if old is not None:
            aside = (self.target, f"{name[1]} (redefined)")
            space[aside] = old
            self.rename = (n.tag, name, aside)
        self.top(n, {})
        self.rename = None

    def top(self, n: Node, replace: dict) -> None:
        n = replace.get((n.tag, n.get("name")), n)
        name = n.get("name")
        if not name:
            self.say("XSD1004", f"xs:{n.tag} without a name", n)
            return
        full = (self.target, name)
        space = getattr(self.out, TOP[n.tag])
        if full in space:
            if full[0] not in (XSD, "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2001/XMLSchema-instance"):  # what is known beforehand stays as it is
                self.say("XSD1202", f"{name} is declared twice", n)
            return
        self.annotated(n, name, (TOP[n.tag], full))
        if n.tag == "element":
            space[full] = self.element(n, True)
        elif n.tag == "attribute":
            space[full] = self.attribute(n, True)
        elif n.tag == "complexType":
            space[full] = self.complex(n, full)
        elif n.tag == "simpleType":
            space[full] = self.simple(n, full)
        elif n.tag == "group":
            body = n.xs("sequence", "choice", "all")
            space[full] = self.group(body[0]) if body else Group("sequence")
        elif n.tag == "attributeGroup":
            space[full] = self.uses(n)
        else:
            space[full] = {"public": n.get("public"), "system": n.get("system")}

    # -- helpers ------------------------------------------------------------------------------------

    def name(self, n: Node, text: str, kind: str) -> Name:
        prefix, _, local = text.rpartition(":")
        space = n.scope.get(prefix) or None
        if prefix and space is None:
            self.say("XSD1201", f"the prefix {prefix} is not bound", n)
        if not prefix and space is None and self.absorbed:
            space = self.target
        full = (space, local)
        renamed = getattr(self, "rename", None)
        if renamed and renamed[1] == full and TOP.get(renamed[0]) == kind:
            full = renamed[2]
        self.refs.append((kind, full, self.uri, n.line))
        return full

    def local(self, n: Node, form: str) -> Name:
        own = n.get("form") or self.root.get(f"{form}FormDefault", "unqualified")
        return (n.get("targetNamespace") or (self.target if own == "qualified" else None), n.get("name") or "")

    def annotation(self, n: Node, owner: str, key: tuple | None = None) -> None:
        own = [d.text.strip() for d in n.xs("documentation")]
        self.out.annotations += [(owner, d) for d in own]
        info = [(x.get("source"), "".join(p if isinstance(p, str) else verbatim(p, True) for p in x.parts)) for x in n.xs("appinfo")]
        if key is not None:
            self.out.docs[key] = {"doc": "\n\n".join(own) if own else None, "appinfo": info}

    def annotated(self, n: Node, owner: str, key: tuple | None = None) -> None:
        for c in n.xs("annotation"):
            self.annotation(c, owner, key)

    def occurs(self, n: Node) -> tuple[int, int]:
        out = []
        for key in ("minOccurs", "maxOccurs"):
            v = n.get(key, "1")
            if v == "unbounded" and key == "maxOccurs":
                out.append(UNBOUNDED)
            elif v.lstrip("+").isdigit():
                out.append(min(int(v), 2**32 - 1))
            else:
                self.say("XSD1005", f"{key} is {v}", n)
                out.append(1)
        if out[1] != UNBOUNDED and out[0] > out[1]:
            self.say("XSD1302", "minOccurs is above maxOccurs", n)
        return out[0], out[1]

    def flags(self, n: Node, key: str) -> tuple[str, ...]:
        v = n.get(key) if n.get(key) is not None else self.root.get(f"{key}Default", "")
        return ("extension", "restriction", "substitution", "list", "union") if v == "#all" else tuple(v.split())

    # -- components ---------------------------------------------------------------------------------

    def element(self, n: Node, top: bool) -> Element:
        inline = n.xs("simpleType", "complexType")
        if n.get("type") and inline:
            self.say("XSD1303", "an element has a type attribute and an inline type", n)
        kind = self.name(n, n.get("type"), "types") if n.get("type") else (self.simple(inline[0], None) if inline[0].tag == "simpleType" else self.complex(inline[0], None)) if inline else None
        heads = tuple(self.name(n, h, "elements") for h in (n.get("substitutionGroup") or "").split())
        name = (self.target, n.get("name")) if top else self.local(n, "element")
        keys = [self.identity(k) for k in n.xs("unique", "key", "keyref")]
        true = lambda k: n.get(k) in ("true", "1")
        return Element(name, kind, true("nillable"), true("abstract"), n.attrs.get("default"), n.attrs.get("fixed"), heads, keys, self.flags(n, "block"), top, self.flags(n, "final"))

    def attribute(self, n: Node, top: bool) -> Attribute:
        if n.get("ref"):
            return Attribute(self.name(n, n.get("ref"), "attributes"), "ref", n.get("use", "optional"), n.attrs.get("default"), n.attrs.get("fixed"))
        inline = n.xs("simpleType")
        kind = self.name(n, n.get("type"), "types") if n.get("type") else self.simple(inline[0], None) if inline else (XSD, "anySimpleType")
        return Attribute((self.target, n.get("name")) if top else self.local(n, "attribute"), kind, n.get("use", "optional"), n.attrs.get("default"), n.attrs.get("fixed"))

    def uses(self, n: Node) -> tuple[list, Wildcard | None]:
        out: list = []
        for c in n.xs("attribute", "attributeGroup"):
            out.append(self.attribute(c, False) if c.tag == "attribute" else self.name(c, c.get("ref", ""), "attribute_groups"))
        names = [a.name for a in out if isinstance(a, Attribute)]
        if len(set(names)) < len(names):
            self.say("XSD1202", "an attribute is declared twice", n)
        wild = n.xs("anyAttribute")
        return out, self.wildcard(wild[0]) if wild else None

    def wildcard(self, n: Node) -> Wildcard:
        # an absent processContents is lax, not the Recommendation's strict
        spaces, process = n.get("namespace", "##any").split(), n.get("processContents", "lax")
        asked = (n.get("notQName") or "").split()
        deny = tuple(self.name(n, x, "none") for x in asked if not x.startswith("##"))
        flags = tuple({"##defined": "defined", "##definedSibling": "sibling"}[x] for x in asked if x in ("##defined", "##definedSibling"))
        bad = [x for x in asked if x.startswith("##") and x not in ("##defined", "##definedSibling")] + [x for x in [*spaces, *(n.get("notNamespace") or "").split()] if x.startswith("##") and x not in ("##targetNamespace", "##local") and not (len(spaces) == 1 and x in ("##any", "##other"))]
        if bad:
            self.say("XSD1005", f"xs:{n.tag} has {bad[0]}", n)
        one = lambda s: {"##targetNamespace": self.target, "##local": None}.get(s, s)
        if n.get("notNamespace") is not None:
            return Wildcard("not", tuple(map(one, n.get("notNamespace").split())), process, deny, flags)
        if spaces == ["##any"]:
            return Wildcard("any", (), process, deny, flags)
        if spaces == ["##other"]:
            return Wildcard("not", (self.target, None) if self.target else (None,), process, deny, flags)
        return Wildcard("in", tuple(map(one, spaces)), process, deny, flags)

    def group(self, n: Node) -> Group:
        out = Group(n.tag)
        for c in n.xs("element", "group", "sequence", "choice", "all", "any"):
            out.items.append(self.particle(c))
            if n.tag == "all" and c.tag == "element" and self.out.version == "1.0" and out.items[-1].high not in (0, 1):
                self.say("XSD1302", "a member of xs:all occurs once at most", c)
            if n.tag == "all" and c.tag in ("sequence", "choice"):
                self.say("XSD1302", "xs:all holds no other compositor", c)
        return out

    def particle(self, n: Node) -> Particle:
        low, high = self.occurs(n)
        if n.tag == "element":
            term: object = self.name(n, n.get("ref"), "elements") if n.get("ref") else self.element(n, False)
            if not n.get("ref") and not n.get("name"):
                self.say("XSD1004", "an element has a name or a ref", n)
        elif n.tag == "any":
            term = self.wildcard(n)
        elif n.tag == "group":
            term = GroupRef(self.name(n, n.get("ref", ""), "groups"))
        else:
            term = self.group(n)
        return Particle(term, low, high)

    def complex(self, n: Node, name: Name | None) -> Complex:
        true = lambda x, k: x.get(k) in ("true", "1")
        out = Complex(name, (XSD, "anyType"), abstract=true(n, "abstract"), block=self.flags(n, "block"), final=self.flags(n, "final"))
        body, mixed = n, true(n, "mixed")
        holder = n.xs("simpleContent", "complexContent")
        if holder:
            mixed = mixed or true(holder[0], "mixed")
            step = holder[0].xs("extension", "restriction")
            if not step:
                self.say("XSD1009", "content without a derivation", holder[0])
                return out
            body = step[0]
            out.derivation = body.tag
            out.base = self.name(body, body.get("base"), "types") if body.get("base") else (XSD, "anyType")
            if holder[0].tag == "simpleContent":
                out.content = "simple"
                out.attributes, out.any_attribute = self.uses(body)
                if body.tag == "restriction" and body.xs(*FACETS) or body.xs("simpleType"):
                    out.simple = self.restriction(body, None, self.simple(body.xs("simpleType")[0], None) if body.xs("simpleType") else ("content", out.base))
                return out
        groups = body.xs("sequence", "choice", "all", "group")
        opened = body.xs("openContent")
        if opened and opened[0].get("mode") != "none" and opened[0].xs("any"):
            out.open = (opened[0].get("mode", "interleave"), self.wildcard(opened[0].xs("any")[0]))
        elif not opened and self.opened and (groups or mixed or self.opened[2]):
            out.open = self.opened[:2]
        if self.out.version == "1.0":
            out.open = None
        if groups:
            out.particle = self.particle(groups[0])
        out.content = "mixed" if mixed else "elements" if groups or out.derivation == "extension" else "empty"
        out.attributes, out.any_attribute = self.uses(body)
        if self.given is not None and n.get("defaultAttributesApply") not in ("false", "0"):
            out.attributes.append(self.given)
        return out

    def simple(self, n: Node, name: Name | None) -> Declared:
        steps = n.xs("restriction", "list", "union")
        if len(steps) != 1:
            self.say("XSD1301" if steps else "XSD1009", "a simple type has one of restriction, list and union", n)
            return Declared(name, "restriction", (XSD, "string"), line=n.line)
        s, inner = steps[0], steps[0].xs("simpleType")
        if s.tag == "restriction":
            if s.get("base") is None and not inner:
                self.say("XSD1009", "a restriction has a base", s)
            return self.restriction(s, name, self.name(s, s.get("base"), "types") if s.get("base") else self.simple(inner[0], None) if inner else (XSD, "string"), self.flags(n, "final"))
        if s.tag == "list":
            return Declared(name, "list", item=self.name(s, s.get("itemType"), "types") if s.get("itemType") else self.simple(inner[0], None) if inner else (XSD, "string"), final=self.flags(n, "final"), line=n.line)
        return Declared(name, "union", members=[*(self.name(s, m, "types") for m in (s.get("memberTypes") or "").split()), *(self.simple(i, None) for i in inner)], final=self.flags(n, "final"), line=n.line)

    def restriction(self, s: Node, name: Name | None, base: object, final: tuple[str, ...] = ()) -> Declared:
        out = Declared(name, "restriction", base, final=final, line=s.line)
        for f in s.xs(*FACETS):
            v = f.attrs.get("value", "")
            if f.tag == "pattern":
                if why := check_pattern(v):
                    self.say("XSD1306", f"the pattern {v}: {why}", f)
                else:
                    out.patterns.append(v)
                    for x in unknown_blocks(v):
                        self.say("XSD1104", f"the block {x} is not known, and stands for any character", f, "warning")
            elif f.tag == "enumeration":
                out.facets.setdefault("enumeration", []).append(v)
            elif f.tag in out.facets:
                self.say("XSD1307", f"{f.tag} comes twice", f)
            elif f.tag in ("length", "minLength", "maxLength", "totalDigits", "fractionDigits", "minScale", "maxScale"):
                if v.lstrip("-" if f.tag.endswith("Scale") else "").isdigit():
                    out.facets[f.tag] = int(v)
                else:
                    self.say("XSD1005", f"{f.tag} is {v}", f)
            elif f.tag != "assertion":
                out.facets[f.tag] = v.strip()
        own = out.facets
        for a, b in (("minInclusive", "minExclusive"), ("maxInclusive", "maxExclusive")):
            if a in own and b in own:
                self.say("XSD1307", f"{a} beside {b}", s)
        return out

    def identity(self, n: Node) -> Identity:
        if n.get("ref") and self.out.version == "1.1":
            return Identity(n.tag, self.name(n, n.get("ref"), "identities"), [], [], ("ref", ""))
        name = (self.target, n.get("name") or "")
        if not n.get("name"):
            self.say("XSD1004", f"xs:{n.tag} without a name", n)
        if n.tag == "keyref" and not n.get("refer"):
            self.say("XSD1004", "a keyref without refer", n)
        select = n.xs("selector")
        if not select or not n.xs("field"):
            self.say("XSD1009", "an identity constraint has a selector and fields", n)
        out = Identity(n.tag, name, self.xpath(select[0], False) if select else [], [self.xpath(f, True) for f in n.xs("field")], self.name(n, n.get("refer"), "identities") if n.get("refer") else None)
        if name in self.idents:
            self.say("XSD1202", f"{name[1]} is declared twice", n)
        self.idents[name] = out
        return out

    def xpath(self, n: Node, is_field: bool) -> list[list[str]]:
        """The alternatives of a selector or field, as steps: names in Clark form, ``*``, ``{ns}*``, ``**`` for any depth, and
        in fields a last ``@name``."""
        text = n.get("xpath")
        if text is None:
            self.say("XSD1004", f"xs:{n.tag} without an xpath", n)
            return []
        default = n.get("xpathDefaultNamespace") or self.root.get("xpathDefaultNamespace") if self.out.version == "1.1" else None
        default = {"##defaultNamespace": n.scope.get("") or None, "##targetNamespace": self.target, "##local": None}.get(default, default)
        out = []
        for alternative in text.split("|"):
            a = "".join(alternative.split())
            deep = a.startswith(".//")
            steps = ["**"] if deep else []
            parts = [p for p in a.removeprefix(".//").split("/") if p != "."] if a != "." else []
            for i, p in enumerate(parts):
                p = p.removeprefix("child::")
                at = p.startswith("@") or p.startswith("attribute::")
                p = p.removeprefix("attribute::").removeprefix("@")
                prefix, _, local = p.rpartition(":")
                fine = (local == "*" or rules._NCNAME.match(local)) and (not prefix or rules._NCNAME.match(prefix)) and (not at or is_field and i + 1 == len(parts))
                if not fine:
                    self.say("XSD1005", f"the path {text!r}", n)
                    break
                space = n.scope.get(prefix) if prefix else None if at or local == "*" else default
                if prefix and space is None:
                    self.say("XSD1201", f"the prefix {prefix} is not bound", n)
                steps.append("@" * at + (f"{{{space}}}{local}" if space else local))
            else:
                out.append(steps)
        return out

    # -- after all documents ------------------------------------------------------------------------

    def finish(self) -> None:
        out = self.out
        spaces = {"elements": out.elements, "types": out.types, "attributes": out.attributes, "groups": out.groups, "attribute_groups": out.attribute_groups, "identities": self.idents}
        lax = out.conformance == "lax"
        for kind, full, uri, line in self.refs:
            if kind in spaces and full not in spaces[kind]:
                out.diagnostics.append(Diagnostic("XSD1201", f"nothing of {kind} is named {full[1]} in {full[0]}", "warning" if lax else "error", uri, line))
        if lax:  # what refers to nothing goes
            for t in out.types.values():
                self.prune(t.particle if isinstance(t, Complex) else None)
            for g in out.groups.values():
                self.prune(Particle(g))
            for e in out.elements.values():
                self.prune(e.type.particle if isinstance(e.type, Complex) else None)
                e.heads = tuple(h for h in e.heads if h in out.elements)
        self.uri = None
        declared = {n: t for n, t in out.types.items() if isinstance(t, Declared)}
        out.declared = {n: (dict(t.facets), list(t.patterns)) for n, t in declared.items()}
        done: dict[int, Simple] = {}
        for full, t in list(out.types.items()):
            if isinstance(t, Declared):
                out.types[full] = self.resolved(t, done, ())
        for t in out.types.values():
            if isinstance(t, Complex):
                self.settle(t, done)
        for e in out.elements.values():
            self.settle_element(e, done)
        for a in out.attributes.values():
            a.type = self.resolved(a.type, done, ()) if isinstance(a.type, Declared) else a.type
        for g in out.groups.values():
            self.settle_group(g, done)
        for uses, _ in out.attribute_groups.values():
            self.settle_uses(uses, done)
        self.cycles()
        direct: dict[Name, list[Name]] = {}
        for full, e in out.elements.items():
            for h in e.heads:
                direct.setdefault(h, []).append(full)
        for head in direct:
            reached, todo = [], list(direct[head])
            while todo:
                m = todo.pop(0)
                if m not in reached and m != head:
                    reached.append(m)
                    todo += direct.get(m, [])
            out.substitutes[head] = reached
        self.named()
        from .automata import check

        for full, t in out.types.items():
            if isinstance(t, Complex) and full[0] != XSD:
                out.diagnostics += check(out, t)
        for code, message in (*rules.substitution_cycles(out), *rules.group_cycles(out)):
            self.say(code, message)
        for code, message in rules.components(out, declared):
            self.say(code, message)

    def prune(self, p: Particle | None) -> None:
        if p is None:
            return
        if isinstance(p.term, Group):
            p.term.items = [x for x in p.term.items if not (isinstance(x.term, tuple) and x.term not in self.out.elements or isinstance(x.term, GroupRef) and x.term.name not in self.out.groups)]
            for x in p.term.items:
                self.prune(x)
        elif isinstance(p.term, Element) and isinstance(p.term.type, Complex):
            self.prune(p.term.type.particle)

    def named(self) -> None:
        """Identity constraints given by reference are those they name."""
        def fill(e: Element) -> None:
            e.keys = [self.idents.get(k.name, k) if k.refer == ("ref", "") else k for k in e.keys]

        for e in self.out.elements.values():
            fill(e)
        for t in self.out.types.values():
            for e in rules._elements(self.out, t.particle) if isinstance(t, Complex) else ():
                fill(e)

    def settle(self, t: Complex, done: dict) -> None:
        if isinstance(t.simple, Declared):
            t.simple = self.resolved(t.simple, done, ())
        self.settle_uses(t.attributes, done)
        if t.particle:
            self.settle_particle(t.particle, done)

    def settle_uses(self, uses: list, done: dict) -> None:
        for i, a in enumerate(uses):
            if isinstance(a, Attribute):
                if a.type == "ref":
                    found = self.out.attributes.get(a.name)
                    a.type = found.type if found else (XSD, "anySimpleType")
                    if found and a.default is None and a.fixed is None:
                        a.default, a.fixed = found.default, found.fixed
                if isinstance(a.type, Declared):
                    a.type = self.resolved(a.type, done, ())

    def settle_particle(self, p: Particle, done: dict) -> None:
        if isinstance(p.term, Element):
            self.settle_element(p.term, done)
        elif isinstance(p.term, Group):
            self.settle_group(p.term, done)

    def settle_group(self, g: Group, done: dict) -> None:
        for p in g.items:
            self.settle_particle(p, done)

    def settle_element(self, e: Element, done: dict) -> None:
        if isinstance(e.type, Declared):
            e.type = self.resolved(e.type, done, ())
        elif isinstance(e.type, Complex):
            self.settle(e.type, done)
        elif e.type is None and e.heads:
            head = self.out.elements.get(e.heads[0])
            e.type = head.type if head else None

    def resolved(self, t: object, done: dict, path: tuple) -> Simple:
        if isinstance(t, tuple) and len(t) == 2 and t[0] == "content":
            return self.out.simple_of(self.out.type_of(t[1])) or Simple()
        if isinstance(t, tuple):
            t = self.out.types.get(t, Simple("anySimpleType"))
        if isinstance(t, Complex):
            return self.out.simple_of(t) or Simple("anySimpleType")
        if isinstance(t, Simple):
            return t
        if id(t) in done:
            return done[id(t)]
        if id(t) in path:
            self.say("XSD1203", f"{t.name and t.name[1]} is defined by itself")
            return Simple("anySimpleType")
        path = (*path, id(t))
        full = f"{{{t.name[0]}}}{t.name[1]}" if t.name and t.name[0] else t.name[1] if t.name else None
        if t.variety == "list":
            out = Simple("string", full, item=self.resolved(t.item, done, path))
        elif t.variety == "union":
            out = Simple("string", full, members=tuple(self.resolved(m, done, path) for m in t.members))
        else:
            base = self.resolved(t.base, done, path)
            self.facets(t, base)
            out = base.restrict(tuple(t.patterns), full, **{k: tuple(v) if isinstance(v, list) else v for k, v in t.facets.items()})
            self.out.simple_base[id_of(out)] = [t.base] if isinstance(t.base, tuple) else []
        done[id(t)] = out
        return out

    def facets(self, t: Declared, base: Simple) -> None:
        for code, message in rules.facets({k: v for k, v in t.facets.items()}, base, self.out.version):
            self.out.diagnostics.append(Diagnostic(code, message, "error", None, t.line))

    def cycles(self) -> None:
        for full, t in self.out.types.items():
            seen = set()
            while isinstance(t, Complex) and t.base is not None and t.name != (XSD, "anyType"):
                if id(t) in seen:
                    self.say("XSD1203", f"{full[1]} derives from itself")
                    t.base = (XSD, "anyType")
                    break
                seen.add(id(t))
                t = self.out.type_of(t.base)


def verbatim(n: Node, top: bool = False) -> str:
    """An element as text; the namespaces in scope are declared on the outermost."""
    names = {v: k for k, v in n.scope.items()}
    tag = f"{names[n.ns]}:{n.tag}" if n.ns and names.get(n.ns) else n.tag
    escape = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    spaces = "".join(f' xmlns{":" + k if k else ""}="{escape(v)}"' for k, v in sorted(n.scope.items()) if k != "xml" and v) if top else ""
    own = "".join(f' {(names.get(k[1:].partition("}")[0], "") + ":" + k.partition("}")[2]) if k.startswith("{") else k}="{escape(v)}"' for k, v in n.attrs.items())
    inner = "".join(escape(p).replace("&quot;", '"') if isinstance(p, str) else verbatim(p) for p in n.parts)
    return f"<{tag}{spaces}{own}>{inner}</{tag}>" if inner else f"<{tag}{spaces}{own}/>"
