"""PDF files as graphs of objects: an index by offset, values by span, and files written with a table of their own.

Objects are found by reading the file from its start, past the streams, so a damaged or missing table does not matter.
Objects inside object streams are read too when these are plain or deflated; a written file holds them as objects of their own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

_SPACE = rb"[\x00\t\n\x0c\r ]"
_HEAD = re.compile(rb"(?<![0-9])([0-9]{1,10})" + _SPACE + rb"+([0-9]{1,5})" + _SPACE + rb"+obj(?![A-Za-z0-9])|(?<![A-Za-z])trailer(?![A-Za-z])")
_GAP = re.compile(rb"(?:" + _SPACE + rb"|%[^\r\n]*)*")
_REF = re.compile(rb"([0-9]{1,10})" + _SPACE + rb"+([0-9]{1,5})" + _SPACE + rb"+R(?![A-Za-z0-9])")
_NAME = re.compile(rb"/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_HEX = re.compile(rb"<[^>]*>")
_TEXT_PART = re.compile(rb"[^()\\]*(?:\\.[^()\\]*)*", re.S)
_STREAM = re.compile(rb"stream(?:\r\n|\n|\r)?")
DEEPEST = 100


class Unreadable(ValueError):
    """The bytes are no PDF whose objects can be told."""


@dataclass(slots=True)
class Value:
    """A value and where it stands. ``inner`` is a dict of (key start, value) by key, a list of values, or the number of an object."""

    kind: str
    start: int
    end: int
    inner: object = None
    cut: bool = False


def parse(data: bytes, at: int, deep: int = 0) -> Value:
    """The value that stands at or behind ``at``."""
    if deep > DEEPEST:
        raise Unreadable("values nested too deeply")
    start = _GAP.match(data, at).end()
    lead = data[start : start + 2]
    if lead == b"<<":
        keys: dict[str, tuple[int, Value]] = {}
        at = _GAP.match(data, start + 2).end()
        while data[at : at + 2] != b">>":
            name = _NAME.match(data, at)
            if not name:
                raise Unreadable("a dictionary without an end")
            value = parse(data, name.end(), deep + 1)
            keys[name[0].decode("latin-1")] = (at, value)
            at = _GAP.match(data, value.end).end()
        return Value("dict", start, at + 2, keys)
    if lead[:1] == b"[":
        items = []
        at = _GAP.match(data, start + 1).end()
        while data[at : at + 1] != b"]":
            if at >= len(data):
                raise Unreadable("an array without an end")
            items.append(parse(data, at, deep + 1))
            at = _GAP.match(data, items[-1].end).end()
        return Value("array", start, at + 1, items)
    if lead[:1] == b"(":
        at, open_ = start + 1, 1
        while open_:
            at = _TEXT_PART.match(data, at).end()
            if at >= len(data):
                raise Unreadable("a string without an end")
            open_ += 1 if data[at : at + 1] == b"(" else -1 if data[at : at + 1] == b")" else 0
            at += 1
        return Value("text", start, at)
    for kind, pattern in (("ref", _REF), ("name", _NAME), ("hex", _HEX), ("word", _WORD)):
        found = pattern.match(data, start)
        if found:
            inner = int(found[1]) if kind == "ref" else found[0].decode("latin-1") if kind in ("name", "word") else None
            return Value(kind, start, found.end(), inner)
    raise Unreadable("no value")


@dataclass(slots=True)
class Object:
    """Value and span of an object; ``source`` holds its bytes, which are the file's or those of an object stream."""

    number: int
    generation: int
    value: Value
    end: int
    source: bytes = field(repr=False)
    stream: tuple[int, int] | None = None


class Pdf:
    def __init__(self, data: bytes) -> None:
        if b"%PDF" not in data[:1024]:
            raise Unreadable("no header")
        self.data = data
        self.objects: dict[int, Object] = {}
        self.trailer: Value | None = None
        at = 0
        while found := _HEAD.search(data, at):
            at = found.end()
            try:
                value = parse(data, at)
            except Unreadable:
                continue
            if found[1] is None:
                if value.kind == "dict":
                    self.trailer = value
                at = value.end
                continue
            one = Object(int(found[1]), int(found[2]), value, value.end, data)
            self._stream(one)
            at = one.end
            # a later object of one number takes the place of the earlier one
            self.objects[one.number] = one
        for one in list(self.objects.values()):
            kind = self.get(one.value, "/Type")
            if kind is not None and kind.inner == "/ObjStm":
                self._unpack(one)
            elif kind is not None and kind.inner == "/XRef" and self.trailer is None:
                self.trailer = one.value
        self.root = self._root()

    def _stream(self, one: Object) -> None:
        begin = _GAP.match(self.data, one.end).end()
        mark = _STREAM.match(self.data, begin)
        if one.value.kind != "dict" or not mark:
            return
        length = one.value.inner.get("/Length")
        end = mark.end() + int(length[1].inner) if length and length[1].kind == "word" and length[1].inner.isdigit() else -1
        if end < 0 or not self.data[end : end + 12].lstrip(b"\r\n").startswith(b"endstream"):
            end = self.data.find(b"endstream", mark.end())
            end = len(self.data) if end < 0 else end
        one.stream = (mark.end(), end)
        one.end = min(len(self.data), self.data.find(b"endstream", end) + 9) if end < len(self.data) else end

    def _unpack(self, one: Object) -> None:
        filters = self.get(one.value, "/Filter")
        if one.stream is None or self.get(one.value, "/DecodeParms") is not None:
            return
        body = self.data[slice(*one.stream)]
        try:
            if filters is not None:
                if filters.inner != "/FlateDecode":
                    return
                body = zlib.decompressobj().decompress(body)
            n, first = (int(self.get(one.value, k).inner) for k in ("/N", "/First"))
            numbers = [int(x) for x in body[:first].split()[: 2 * n]]
            for number, offset in zip(numbers[::2], numbers[1::2], strict=True):
                value = parse(body, first + offset)
                self.objects.setdefault(number, Object(number, 0, value, value.end, body))
        except (AttributeError, TypeError, ValueError, zlib.error):
            return

    def _root(self) -> int:
        named = self.trailer.inner.get("/Root") if self.trailer is not None else None
        if named and named[1].kind == "ref" and named[1].inner in self.objects:
            return named[1].inner
        for one in self.objects.values():
            kind = self.get(one.value, "/Type")
            if kind is not None and kind.inner == "/Catalog":
                return one.number
        raise Unreadable("no catalog")

    def get(self, holder: Value | None, key: str) -> Value | None:
        """Value of a key, behind its reference if it is one."""
        if holder is None or holder.kind != "dict" or key not in holder.inner:
            return None
        return self.resolve(holder.inner[key][1])

    def resolve(self, value: Value) -> Value | None:
        seen = set()
        while value.kind == "ref":
            if value.inner in seen or value.inner not in self.objects:
                return None
            seen.add(value.inner)
            value = self.objects[value.inner].value
        return value


def dicts(value: Value) -> Iterator[Value]:
    """All dictionaries inside a value, the value itself first; references are not followed."""
    todo = [value]
    while todo:
        v = todo.pop()
        if v.kind == "dict":
            yield v
            todo += [inner for _, inner in reversed(v.inner.values())]
        elif v.kind == "array":
            todo += reversed(v.inner)


def reference_numbers(value: Value) -> Iterator[int]:
    todo = [value]
    while todo:
        v = todo.pop()
        if v.kind == "ref":
            yield v.inner
        elif v.kind == "dict":
            todo += [inner for _, inner in v.inner.values()]
        elif v.kind == "array":
            todo += v.inner


def drop(holder: Value, key: str) -> Value | None:
    """Take a key out of a dictionary and return its value; ``write`` leaves it out."""
    found = holder.inner.pop(key, None)
    holder.cut |= found is not None
    return None if found is None else found[1]


def reachable(pdf: Pdf) -> set[int]:
    """Numbers of the objects that the catalog leads to by keys that were not dropped."""
    seen, todo = set(), [pdf.root]
    while todo:
        number = todo.pop()
        if number in pdf.objects and number not in seen:
            seen.add(number)
            todo += reference_numbers(pdf.objects[number].value)
    return seen


def _touched(value: Value) -> bool:
    inner = [v for _, v in value.inner.values()] if value.kind == "dict" else value.inner if value.kind == "array" else []
    return value.cut or any(map(_touched, inner))


def spelt(value: Value, source: bytes) -> bytes:
    """Bytes of a value without the keys that were dropped; what was not touched stays byte for byte."""
    if not _touched(value):
        return source[value.start : value.end]
    if value.kind == "array":
        return b"[" + b" ".join(spelt(v, source) for v in value.inner) + b"]"
    return b"<< " + b"".join(key.encode("latin-1") + b" " + spelt(v, source) + b" " for key, (_, v) in value.inner.items()) + b">>"


def write(pdf: Pdf, numbers: set[int], append: bool = False, info: bool = True) -> bytes:
    """A file of these objects with a table of offsets. Tables and object streams of the old file are left out.

    ``append`` leaves all old bytes in place and adds the objects, their table and a trailer behind them.
    """
    out = bytearray(pdf.data if append else pdf.data[: pdf.data.find(b"\n") + 1] or b"%PDF-1.4\n")
    if append and not out.endswith(b"\n"):
        out += b"\n"
    offsets: dict[int, tuple[int, int]] = {}
    for number in sorted(numbers):
        one = pdf.objects[number]
        kind = one.value.inner.get("/Type") if one.value.kind == "dict" else None
        if kind and kind[1].inner in ("/XRef", "/ObjStm"):
            continue
        offsets[number] = (len(out), one.generation)
        out += b"%d %d obj\n" % (number, one.generation) + spelt(one.value, one.source)
        if one.stream:
            out += b"\nstream\n" + pdf.data[slice(*one.stream)] + b"\nendstream"
        out += b"\nendobj\n"
    at = len(out)
    out += b"xref\n"
    if not append:
        out += b"0 1\n0000000000 65535 f \n"
    for run in _runs(sorted(offsets)):
        out += b"%d %d\n" % (run[0], len(run)) + b"".join(b"%010d %05d n \n" % offsets[n] for n in run)
    size = max(pdf.objects, default=0) + 1
    extra = b""
    if info and pdf.trailer is not None and "/Info" in pdf.trailer.inner:
        held = pdf.trailer.inner["/Info"][1]
        extra += b" /Info " + spelt(held, pdf.data) if held.kind != "ref" or held.inner in offsets else b""
    if append:
        before = re.findall(rb"startxref\s+([0-9]+)", pdf.data)
        extra += b" /Prev " + before[-1] if before else b""
    out += b"trailer\n<< /Size %d /Root %d %d R%s >>\nstartxref\n%d\n%%%%EOF\n" % (size, pdf.root, pdf.objects[pdf.root].generation, extra, at)
    return bytes(out)


def _runs(numbers: list[int]) -> Iterator[list[int]]:
    start = 0
    for i in range(1, len(numbers) + 1):
        if i == len(numbers) or numbers[i] != numbers[i - 1] + 1:
            yield numbers[start:i]
            start = i
