"""The text of a document's bytes: by its mark, else its declaration, else UTF-8.  Bytes that contradict it are an error."""

from __future__ import annotations

import codecs
import re

_MARKS = ((codecs.BOM_UTF32_LE, None), (codecs.BOM_UTF32_BE, None), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_SAID = re.compile(rb"""^\s*<\?xml\s[^>]*?encoding\s*=\s*["']([^"'>]*)["']""")
#: Labels that mean windows-1252 on the web.
_WESTERN = {"iso-8859-1", "iso8859-1", "iso_8859-1", "latin1", "l1", "ascii", "us-ascii", "cp1252", "windows-1252"}


class EncodingProblem(ValueError):
    """``code`` is XSD1006 for an encoding that is not known, XSD1007 for bytes that are not of it."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def encoding_of(data: bytes) -> tuple[str | None, int]:
    """(encoding, bytes of the mark)."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            if name is None:
                raise EncodingProblem("XSD1006", "UTF-32 is not read")
            return name, len(mark)
    said = _SAID.match(data[:1024])
    if not said:
        return None, 0
    label = said[1].decode("latin-1").strip().lower()
    if label in _WESTERN:
        return "cp1252", 0
    if label.startswith("utf-16"):
        return "utf-8", 0  # the declaration was read as single bytes, so it can't be true
    try:
        return codecs.lookup(label).name, 0
    except LookupError:
        raise EncodingProblem("XSD1006", f"the encoding {label} is not known") from None


def text_of(data: bytes) -> str:
    name, mark = encoding_of(data)
    try:
        return data[mark:].decode(name or "utf-8")
    except UnicodeDecodeError as e:
        if name == "cp1252":  # its five bytes without a character are controls on the web
            return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in data[mark:])
        raise EncodingProblem("XSD1007", f"the bytes are not {name or 'utf-8'}: {e.reason} at {e.start}") from None


def nesting(text: str) -> int:
    """How deep tags nest, at most: end tags close, and tags in entity literals count wherever they stand."""
    deepest = depth = 0
    for m in re.finditer(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(/)?[A-Za-z_:\u0080-\U0010ffff][^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*(/)?>", text, re.S):
        if m[0].startswith(("<!", "<?")):
            continue
        if m[1]:
            depth = max(depth - 1, 0)
        elif not m[0].endswith("/>"):
            depth += 1
            deepest = max(deepest, depth)
        else:
            deepest = max(deepest, depth + 1)
    return deepest
