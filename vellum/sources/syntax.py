"""Objects of the page description format, read from bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache


class Name(str):
    __slots__ = ()


class Operator(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int = 0


@dataclass
class Stream:
    info: dict
    raw: bytes


_SPACE = b"\0\t\n\f\r "
NOT_HEX = bytes(set(range(256)) - set(b"0123456789abcdefABCDEF"))
_TOKEN = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*(?:(?P<number>[+-]*(?:\d+\.?\d*|\.\d+)(?:-\d*)?(?=[\0\t\n\f\r ()<>\[\]{}/%]|$))|/(?P<name>[^\0\t\n\f\r ()<>\[\]{}/%]*)|(?P<mark><<|>>|[\[\]{}(])|<(?P<hex>[^>]*)>?|(?P<word>[^\0\t\n\f\r ()<>\[\]{}/%]+)|(?P<stray>[)>]))")
_REF = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}
_CLOSE = object()
END = object()


def _hex(text: bytes) -> bytes:
    digits = text.translate(None, NOT_HEX)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


@lru_cache(4096)
def _name(text: bytes) -> Name:
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), text).decode("latin-1"))


@lru_cache(4096)
def _word(text: bytes) -> Operator | bool | None:
    return {b"true": True, b"false": False, b"null": None}.get(text, Operator(text.decode("latin-1")))


class Lexer:
    """Reads objects one after the other; damaged input gives what can be read."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def next(self, depth: int = 0):
        """The next object or operator; ``END`` at the end."""
        m = _TOKEN.match(self.data, self.at)
        if not m:
            self.at = len(self.data)
            return END
        self.at, kind = m.end(), m.lastgroup
        text = m[kind]
        if kind == "number":
            return self._number(text)
        if kind == "name":
            return _name(text)
        if kind == "hex":
            return _hex(text)
        if kind == "word":
            return _word(text)
        if text == b"(":
            return self._string()
        if depth > 100:
            return None
        if text == b"[":
            return self._until(b"]", depth)
        if text == b"<<":
            items = self._until(b">>", depth)
            return {str(k): v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
        return _CLOSE if text in (b"]", b">>", b"}") else self.next(depth)

    def _until(self, close: bytes, depth: int) -> list:
        items = []
        while (x := self.next(depth + 1)) is not END and x is not _CLOSE:
            if isinstance(x, Operator) and x in ("endobj", "stream", "obj"):
                break
            items.append(x)
        return items

    def _number(self, text: bytes):
        if self.refs and text.isdigit() and (m := _REF.match(self.data, self.at)):
            self.at = m.end()
            return Ref(int(text), int(m[1]))
        if text.isdigit():
            return int(text)
        plain = text.lstrip(b"+-")
        plain = plain.split(b"-")[0] or b"0"
        value = float(plain) if b"." in plain else int(plain)
        return -value if text[:1] == b"-" else value

    def _string(self) -> bytes:
        data, at, out, depth = self.data, self.at, bytearray(), 1
        while at < len(data):
            c = data[at]
            at += 1
            if c == 0x5C and at < len(data):
                e = data[at]
                at += 1
                if e in _ESCAPES:
                    out += _ESCAPES[e]
                elif 0x30 <= e <= 0x37:
                    digits = re.compile(rb"[0-7]{1,3}").match(data, at - 1)[0]
                    at += len(digits) - 1
                    out.append(int(digits, 8) & 255)
                elif e == 13:
                    at += data[at : at + 1] == b"\n"
                elif e != 10:
                    out.append(e)
                continue
            depth += (c == 0x28) - (c == 0x29)
            if depth == 0:
                break
            out.append(c)
        self.at = at
        return bytes(out)


def operations(data: bytes, inline: bool = False) -> Iterator[tuple[str, list]]:
    """Operators of a content stream with their operands; inline images are skipped, or with ``inline`` given whole as ``BI``."""
    lexer, operands = Lexer(data, refs=False), []
    match = _TOKEN.match
    while True:
        # Strings and words, most of a page, without a call for each.
        m = match(data, lexer.at)
        kind = m.lastgroup if m else None
        if kind == "hex":
            lexer.at = m.end()
            operands.append(_hex(m[kind]))
            continue
        if kind == "word":
            lexer.at = m.end()
            x = _word(m[kind])
        elif (x := lexer.next()) is END:
            return
        if x is _CLOSE:
            continue
        if not isinstance(x, Operator):
            operands.append(x)
            continue
        if x == "BI":
            end = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|$)").search(data, lexer.at)
            begin, lexer.at = lexer.at, end.end() if end else len(data)
            if inline:
                yield "BI", [data[begin : lexer.at]]
        else:
            yield str(x), operands
        operands = []


def write(value) -> bytes:
    """An object as bytes."""
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if value is None:
        return b"null"
    if isinstance(value, Ref):
        return b"%d %d R" % (value.number, value.generation)
    if isinstance(value, Name):
        return b"/" + re.sub(rb"[^!-\"$&'*-.0-;=?-Z\\^-z|~]", lambda m: b"#%02X" % m[0][0], value.encode("latin-1"))
    if isinstance(value, (int, float)):
        return (b"%d" % value) if value == int(value) else (b"%.6f" % value).rstrip(b"0").rstrip(b".")
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, dict):
        return b"<< " + b" ".join(write(Name(k)) + b" " + write(v) for k, v in value.items()) + b" >>"
    if isinstance(value, Stream):
        return write({**value.info, "Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    if isinstance(value, (list, tuple)):
        return b"[" + b" ".join(map(write, value)) + b"]"
    return str(value).encode("latin-1")
