"""Text of PDF files: what their streams show, in the characters that the fonts say.

Objects are found by their headings, and those inside object streams too. A font's ToUnicode map gives the characters of
its codes; fonts without one are taken as Latin-1. Streams are unpacked piece by piece, with a bound on all together.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field

from graysift.sources.inflate import inflated, unzipped

_ESCAPED = {ord("n"): 10, ord("r"): 10, ord("t"): 9, ord("b"): 8, ord("f"): 12}


def _literal(data: bytes, at: int) -> tuple[str, int]:
    """The string in parentheses that opens at a place, and where it ends: parentheses nest, a backslash takes a letter, up to
    three octal digits or the end of a line."""
    out, depth, at = bytearray(), 1, at + 1
    while at < len(data):
        c = data[at]
        if c == 0x5C and at + 1 < len(data):
            octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            if data[at + 1] not in b"\r\n":
                out.append(_ESCAPED.get(data[at + 1], data[at + 1]))
            at += 2
            continue
        depth += (c == 0x28) - (c == 0x29)
        at += 1
        if not depth:
            break
        out.append(c)
    return out.decode("latin-1"), at


def _hexadecimal(data: bytes, at: int) -> tuple[str, int]:
    """The string in angle brackets that opens at a place, and where it ends. A last odd digit has a 0 after it."""
    end = data.find(b">", at)
    end = len(data) if end < 0 else end
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
    text = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    return text, end + 1


_TOKEN = re.compile(rb"<<|>>|[()<\[\]]|%[^\r\n]*|/[^\s()<>\[\]/%]*|[^\s()<>\[\]/%]+")



def visible(text: str) -> str:
    """Of a hexadecimal string in a font without a map, what is no control character."""
    return "".join(c for c in text if c == "\n" or c >= " ")


@dataclass
class CodeMap:
    """Characters by code, and the bytes that a code has."""

    size: int = 1
    text: dict[int, str] = field(default_factory=dict)

    def shown(self, raw: str) -> str:
        codes = [ord(c) for c in raw]
        if self.size == 2:
            codes = [a << 8 | b for a, b in zip(codes[::2], codes[1::2], strict=False)]
        return "".join(self.text.get(c, "") for c in codes)


_MAPPED = re.compile(rb"begin(bfchar|bfrange)(.*?)end(?:bfchar|bfrange)", re.S)
_HEX = rb"<([0-9A-Fa-f\s]*)>"
_CHARACTER = re.compile(_HEX + rb"\s*" + _HEX)
_RANGE = re.compile(_HEX + rb"\s*" + _HEX + rb"\s*(?:" + _HEX + rb"|\[((?:\s*<[0-9A-Fa-f\s]*>)*)\s*\])")


def code_map(stream: bytes) -> CodeMap:
    """The map that a ToUnicode stream describes: single codes, and ranges with a first character or one for each code."""
    out = CodeMap()
    number = lambda x: int(b"".join(x.split()) or b"0", 16)
    text = lambda x: bytes.fromhex((h := b"".join(x.split()).decode()) + "0" * (len(h) % 2)).decode("utf-16-be", "replace")
    for kind, entries in _MAPPED.findall(stream):
        if kind == b"bfchar":
            found = [(code, code, to, b"") for code, to in _CHARACTER.findall(entries)]
        else:
            found = _RANGE.findall(entries)
        for low, high, to, each in found:
            out.size = 2 if len(b"".join(low.split())) > 2 else 1
            first, last = number(low), min(number(high), number(low) + 0xFFFF)
            if each:
                out.text.update(zip(range(first, last + 1), map(text, re.findall(rb"<([^>]*)>", each)), strict=False))
            elif start := text(to):
                out.text.update((c, start[:-1] + chr(min(ord(start[-1]) + c - first, 0x10FFFF))) for c in range(first, last + 1))
    return out


def shown_strings(content: bytes, fonts: dict[bytes, CodeMap] | None = None) -> list[str]:
    """What the operators that show text (Tj, TJ, ' and \") are given in a content stream: one string for each operator."""
    out, held, at, font, named = [], [], 0, None, b""
    while m := _TOKEN.search(content, at):
        token, at = m[0], m.end()
        if token == b"(":
            text, at = _literal(content, m.start())
            held.append(font.shown(text) if font else text)
        elif token == b"<":
            text, at = _hexadecimal(content, m.start())
            held.append(font.shown(text) if font else visible(text))
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            out.append("".join(held))
            held = []
        elif token[:1] == b"/":
            named = token[1:]
        elif token == b"Tf":
            font = (fonts or {}).get(named)
        elif token[:1].isalpha():
            held = []
    return out


_HEADING = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n?(.*?)endstream", re.S)
_BODY_END = re.compile(rb"stream|endobj")
_REFERENCE = re.compile(rb"\s*(\d+)\s+\d+\s+R")


class Document:
    """The objects of a file by number, and its streams in order."""

    def __init__(self, data: bytes, most: int):
        self.left, self.objects, self.streams = most, {}, []
        heads = [(m.end(), int(m[1])) for m in _HEADING.finditer(data)]
        starts = [h[0] for h in heads]
        for k, (begin, number) in enumerate(heads):
            end = heads[k + 1][0] if k + 1 < len(heads) else len(data)
            m = _BODY_END.search(data, begin, end)
            self.objects[number] = data[begin : m.start() if m else end]
        self.content: dict[int, bytes] = {}
        for m in _STREAM.finditer(data):
            k = bisect_right(starts, m.start()) - 1
            number = heads[k][1] if k >= 0 else -1 - len(self.streams)
            self.content[number] = self._unpacked(m[1])
            self.streams.append(number)
        for number in self.streams:
            if b"/ObjStm" in self.objects.get(number, b""):
                self._inner(self.objects[number], self.content[number])

    def _unpacked(self, raw: bytes) -> bytes:
        try:
            content = b"".join(inflated(unzipped(raw), self.left))
        except zlib.error:
            content = raw
        self.left -= len(content)
        return content

    def _inner(self, head: bytes, content: bytes) -> None:
        """The objects inside an object stream: pairs of numbers and places, then the objects."""
        first = re.search(rb"/First\s+(\d+)", head)
        if not first:
            return
        begin = int(first[1])
        numbers = [int(x) for x in re.findall(rb"\d+", content[:begin])]
        places = [*zip(numbers[::2], numbers[1::2], strict=False)]
        for k, (number, at) in enumerate(places):
            self.objects.setdefault(number, content[begin + at : begin + places[k + 1][1] if k + 1 < len(places) else None])

    def value(self, body: bytes, key: bytes) -> bytes:
        """What stands after a name in an object: a dictionary or list as it is, the object that a reference names, or nothing."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
        if not m:
            return b""
        if r := _REFERENCE.match(body, m.end()):
            return self.objects.get(int(r[1]), b"")
        opening = body[m.end() : m.end() + 2]
        if opening[:1] == b"[":
            return body[m.end() : body.find(b"]", m.end()) + 1]
        if opening != b"<<":
            return b""
        depth = 0
        for t in re.finditer(rb"<<|>>", body[m.end() :]):
            depth += 1 if t[0] == b"<<" else -1
            if not depth:
                return body[m.end() : m.end() + t.end()]
        return body[m.end() :]

    def fonts(self) -> dict[int, dict[bytes, CodeMap]]:
        """For each content stream the maps of its fonts by name: those of the pages that show it (with what they inherit) or, for
        a form, its own."""
        found: dict[int, dict[bytes, CodeMap]] = {}
        maps: dict[int, CodeMap] = {}

        def of(resources: bytes) -> dict[bytes, CodeMap]:
            out = {}
            for name, number in re.findall(rb"/([^\s()<>\[\]/%]+)\s+(\d+)\s+\d+\s+R", self.value(resources, b"Font")):
                font = self.objects.get(int(number), b"")
                if r := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", font):
                    at = int(r[1])
                    if at not in maps:
                        maps[at] = code_map(self.content.get(at, b""))
                    out[name] = maps[at]
            return out

        for number, body in list(self.objects.items()):
            if re.search(rb"/Type\s*/Page(?![A-Za-z])", body):
                resources, up = self.value(body, b"Resources"), body
                for _ in range(16):
                    if resources or not (up := self.value(up, b"Parent")):
                        break
                    resources = self.value(up, b"Resources")
                held = re.search(rb"/Contents\s*((?:\d+\s+\d+\s+R)|\[[^\]]*\])", body)
                for at in re.findall(rb"(\d+)\s+\d+\s+R", held[1] if held else b""):
                    found.setdefault(int(at), {}).update(of(resources))
            elif number in self.content and b"/Resources" in body:
                found.setdefault(number, {}).update(of(self.value(body, b"Resources")))
        return found


def pdf_text(data: bytes, most: int = 1 << 27) -> str:
    """What the streams of a PDF show, in order of the file; most: bytes that all of them may unpack to."""
    document = Document(data, most)
    fonts, out = document.fonts(), []
    for number in document.streams:
        content = document.content[number]
        if re.search(rb"BT|Tj|TJ", content):
            out += [text + " " for text in shown_strings(content, fonts.get(number)) if text]
    # Runs of blanks and of newlines become one blank, two newlines.
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", "".join(out))).strip()
