"""Texts of the pages of plain PDF files, without a PDF library.

Read are files whose pages show simple fonts (one byte a character) from plain or deflated streams, with objects in the body or in object streams.
What isn't read raises, so that a page is marked as failed instead of passing as empty: encryption, other filters, composite fonts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_STREAM = re.compile(rb"stream\r?\n")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A string, a hex string, an array's border, a number, a name or an operator of a content stream.
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|[\[\]]|[+-]?\d*\.?\d+|/[^\s/()<>\[\]]*|[A-Za-z'\"*][A-Za-z0-9'\"*]*|<<|>>", re.S)
#: A shift to the left by over so many thousandths of the font's size counts as a blank.
_BLANK = 200


def _inflated(head: bytes, data: bytes) -> bytes:
    filters = re.findall(rb"/Filter\s*(\[[^\]]*\]|/\w+)", head)
    names = re.findall(rb"/(\w+)", filters[0]) if filters else []
    for name in names:
        if name not in (b"FlateDecode", b"Fl"):
            raise ValueError(f"filter {name.decode()} isn't read")
        data = zlib.decompressobj().decompress(data)
    return data


def _objects(data: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """Each object's head (all before its stream) and its stream as stored."""
    out: dict[int, tuple[bytes, bytes | None]] = {}
    at = 0
    while m := _OBJECT.search(data, at):
        end = data.find(b"endobj", m.end())
        end = len(data) if end < 0 else end
        s = _STREAM.search(data, m.end(), end)
        if s:
            head = data[m.end() : s.start()]
            n = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
            stop = s.end() + int(n[1]) if n else data.find(b"endstream", s.end())
            if stop < s.end() or stop > len(data):
                raise ValueError("a stream is cut off")
            out[int(m[1])] = head, data[s.end() : stop]
            end = data.find(b"endobj", stop)
            end = len(data) if end < 0 else end
        else:
            out[int(m[1])] = data[m.end() : end], None
        at = end
    for head, stream in list(out.values()):
        if stream is not None and re.search(rb"/Type\s*/ObjStm\b", head):
            body = _inflated(head, stream)
            first = int(re.search(rb"/First\s+(\d+)", head)[1])
            places = [int(x) for x in body[:first].split()]
            pairs = list(zip(places[::2], places[1::2]))
            for (number, start), (_, stop) in zip(pairs, [*pairs[1:], (0, len(body) - first)]):
                out.setdefault(number, (body[first + start : first + stop], None))
    return out


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
    plain = lambda m: _ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r", b"\r\n") else bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S).decode("cp1252", "replace")


def _shown(content: bytes) -> str:
    """The text that a content stream shows: a new line where the place is set anew, a blank for a wide gap."""
    out: list[str] = []
    operands: list[bytes] = []
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/+-.0123456789" and t not in (b"<<", b">>"):
            operands.append(t)
            continue
        if t in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"', b"BT") and out and out[-1] != "\n":
            out.append("\n")
        if t in (b"Tj", b"'", b'"'):
            out += [_string(x) for x in operands[-1:] if x[:1] in b"(<"]
        elif t == b"TJ":
            for x in operands:
                if x[:1] in b"(<":
                    out.append(_string(x))
                elif x[:1] in b"+-.0123456789" and float(x) < -_BLANK and out:
                    out.append(" ")
        operands = []
    return "".join(out).strip("\n")


def _pages(objects: dict[int, tuple[bytes, bytes | None]]) -> Iterator[bytes]:
    """Page dictionaries in the order of the page tree."""
    kind = lambda head: (re.search(rb"/Type\s*/(Pages|Page)\b", head) or [b"", b""])[1]

    def walk(number: int, seen: set[int]) -> Iterator[bytes]:
        head = objects.get(number, (b"", None))[0]
        if number in seen:
            raise ValueError("the page tree goes round")
        if kind(head) == b"Page":
            yield head
        elif kids := re.search(rb"/Kids\s*\[([^\]]*)\]", head):
            for k in _REF.findall(kids[1]):
                yield from walk(int(k), seen | {number})

    roots = [n for n, (head, _) in objects.items() if kind(head) == b"Pages" and not re.search(rb"/Parent\b", head)]
    if not roots:
        raise ValueError("there is no page tree")
    for r in roots:
        yield from walk(r, set())


def page_texts(data: bytes) -> list[str]:
    """The text of each page, in order: a reader for readers.extract_pages()."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("not a PDF")
    if re.search(rb"/Encrypt\b", data):
        raise ValueError("encrypted files aren't read")
    objects = _objects(data)
    if any(re.search(rb"/Subtype\s*/Type0\b", head) for head, _ in objects.values()):
        raise ValueError("composite fonts aren't read")
    out = []
    for head in _pages(objects):
        contents = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head)
        parts = []
        for n in _REF.findall(contents[1]) if contents else []:
            own, stream = objects.get(int(n), (b"", None))
            if stream is None:
                raise ValueError("a page's content is missing")
            parts.append(_inflated(own, stream))
        out.append(_shown(b"\n".join(parts)))
    return out
