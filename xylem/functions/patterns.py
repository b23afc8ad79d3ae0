"""XSD regular expressions as Java ones, anchored to the whole value."""

from __future__ import annotations

import re
from functools import lru_cache

from .builtins import _NAME, _NAME0


class PatternError(ValueError):
    pass


_CLASSES = {"i": f":{_NAME0}", "c": f":{_NAME}", "d": r"\p{Nd}", "s": r" \t\n\r"}
#: The Unicode categories that patterns may name.
_CATEGORIES = set("L Lu Ll Lt Lm Lo M Mn Mc Me N Nd Nl No P Pc Pd Ps Pe Pi Pf Po Z Zs Zl Zp S Sm Sc Sk So C Cc Cf Co Cn".split())
#: Blocks whose names have changed since XSD named them.
_RENAMED = {"Greek": "GreekandCoptic", "CombiningMarksforSymbols": "CombiningDiacriticalMarksforSymbols", "PrivateUse": "PrivateUseArea"}
_PLAIN = set("nrt\\|.?*+(){}-[]^")


def translate(pattern: str, python: bool = False) -> str:
    """The Java form of one XSD pattern (for ``python``, that of the ``regex`` module)."""
    out, i, depth, piece_before = [], 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            piece, i = _class(pattern, i, python)
            out.append(piece)
            piece_before = True
            continue
        if c == "\\":
            piece, i = _escape(pattern, i, False, python)
            out.append(piece)
            piece_before = True
            continue
        if c == "(":
            depth += 1
            out.append("(?:")
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise PatternError("unbalanced )")
            out.append(c)
        elif c == ".":
            out.append(r"[^\n\r]")
        elif c in "^$":
            out.append("\\" + c)
        elif c in "?*+{":
            if not piece_before:
                raise PatternError(f"nothing before {c}")
            if c == "{":
                m = re.compile(r"\{([0-9]+)(?:(,)([0-9]*))?\}").match(pattern, i)
                if not m or m[3] and int(m[3]) < int(m[1]):
                    raise PatternError("not a quantity")
                out.append(m[0])
                i = m.end()
            else:
                out.append(c)
                i += 1
            piece_before = False
            continue
        elif c == "]":
            raise PatternError("unbalanced ]")
        elif c == "}":
            raise PatternError("unbalanced }")
        else:
            out.append(c)
        piece_before = c not in "(|"
        i += 1
    if depth:
        raise PatternError("unbalanced (")
    return "".join(out)


@lru_cache(512)
def block(name: str) -> tuple[tuple[int, int], ...] | None:
    """The code points of a Unicode block, without surrogates; nothing for an unknown one."""
    import regex

    if not re.fullmatch("[A-Za-z0-9-]+", name):
        return None
    try:
        p = regex.compile(rf"\p{{In{_RENAMED.get(name, name)}}}+")
    except regex.error:
        return None
    plane = lambda lo, hi: "".join(map(chr, range(lo, hi)))
    out = []
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        out += [(lo + m.start(), lo + m.end() - 1) for m in p.finditer(plane(lo, hi))]
    return tuple(out) or None


def unknown_blocks(pattern: str) -> list[str]:
    return [x for x in re.findall(r"\\[pP]\{Is([^}]*)\}", pattern) if block(x) is None]


def _code(point: int, python: bool) -> str:
    return f"\\U{point:08x}" if python else f"\\x{{{point:X}}}"


def _escape(p: str, i: int, inside: bool, python: bool = False) -> tuple[str, int]:
    if i + 1 >= len(p):
        raise PatternError("nothing after \\")
    c = p[i + 1]
    if c in _PLAIN:
        return p[i : i + 2], i + 2
    if c in "pP":
        end = p.find("}", i)
        if p[i + 2 : i + 3] != "{" or end < 0:
            raise PatternError("\\p without a property")
        name = p[i + 3 : end]
        if name.startswith("Is"):
            ranges = block(name[2:])
            if ranges is None:  # nothing is known of it, so it stands for any character
                return (r"\x{0}-\x{10FFFF}" if not python else r"\U00000000-\U0010ffff") if inside else r"[\s\S]", end + 1
            body = "".join(f"{_code(a, python)}-{_code(b, python)}" for a, b in ranges)
            return (body if inside and c == "p" else f"[{'^' * (c == 'P')}{body}]"), end + 1
        if name not in _CATEGORIES:
            raise PatternError(f"no category {name}")
        return f"\\{c}{{{name}}}", end + 1
    low = c.lower()
    if low == "w":
        body = r"\p{L}\p{M}\p{N}\p{S}"
    elif low in _CLASSES:
        body = _CLASSES[low]
    else:
        raise PatternError(f"unknown escape \\{c}")
    if inside and c == low:
        return body, i + 2
    return f"[{'^' * (c != low)}{body}]", i + 2


def _class(p: str, i: int, python: bool) -> tuple[str, int]:
    out, i = ["["], i + 1
    if p[i : i + 1] == "^":
        out.append("^")
        i += 1
    some = False
    while i < len(p):
        c = p[i]
        if c == "]" and some:
            return "".join(out) + "]", i + 1
        if c == "-" and p[i + 1 : i + 2] == "[" and some:
            inner, i = _class(p, i + 1, python)
            if p[i : i + 1] != "]":
                raise PatternError("text after a subtraction")
            # Java's intersection binds a leading ^ to its left part only, so the class nests
            own = "".join(out) + "]"
            return (f"[{own}--{inner}]" if python else f"[{own}&&[^{inner}]]"), i + 1
        if c == "\\":
            piece, i = _escape(p, i, True, python)
            out.append(piece)
        else:
            out.append("\\" + c if c in "[&^~" else c)
            i += 1
        some = True
    raise PatternError("unbalanced [")


def anchored(patterns: list[str]) -> str:
    """One step: any of its patterns, over the whole value."""
    return r"\A(?:" + "|".join(translate(p) for p in patterns) + r")\z"
