"""A document's objects, pages and geometry, from its bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.geometry import Matrix, Rect, page_matrix_of
from . import codec
from .syntax import END, Lexer, Name, Operator, Ref, Stream

_HEADER = re.compile(rb"(?<!\d)(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj\b")
_ENTRY = re.compile(rb"[\0\t\n\f\r ]*(\d{10}) \d{5} ([nf])(?=[\0\t\n\f\r ])")
DEFAULT_BOX = (0.0, 0.0, 595.0, 842.0)
PROBE = 4096


@dataclass
class Page:
    number: int
    obj_id: int
    info: dict
    media: Rect
    crop: Rect | None
    rotate: int
    is_fallback: bool = False

    @property
    def box(self) -> Rect:
        return self.media & self.crop if self.crop else self.media

    @property
    def matrix(self) -> Matrix:
        """From the page's space to top-down space at the origin."""
        return page_matrix_of(self.box, self.rotate)

    @property
    def rect(self) -> Rect:
        return self.matrix.box(self.box)


class Document:
    def __init__(self, data: bytes):
        self.data = data
        self.offsets: dict[int, int] = {}  # where an object stands; the first definition found wins
        self.packed: dict[int, tuple[int, int]] = {}  # object stream and place in it
        self.trailer: dict = {}
        self.cache: dict[int, object] = {}
        self.bundles: dict[int, dict[int, object]] = {}
        self.start = 0
        self._read_xref()
        self.repaired = not self.offsets and not self.packed
        if self.repaired:
            self._scan()
        self.is_encrypted = "Encrypt" in self.trailer

    # ---- cross references ----

    def _read_xref(self) -> None:
        found = self.data.rfind(b"startxref")
        if found < 0:
            return
        m = re.compile(rb"startxref[\0\t\n\f\r ]*(\d+)").match(self.data, found)
        queue, seen = [int(m[1])] if m else [], set()
        self.start = queue[0] if queue else 0
        while queue:
            at = queue.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            head = self.data[at : at + 64].lstrip(b"\0\t\n\f\r ")
            info = self._table(at) if head.startswith(b"xref") else self._xref_stream(at)
            if info is None:
                continue
            for k, v in info.items():
                self.trailer.setdefault(k, v)
            queue = [int(info[k]) for k in ("XRefStm", "Prev") if isinstance(info.get(k), (int, float))] + queue

    def _known(self, number: int) -> bool:
        return number in self.offsets or number in self.packed

    def _table(self, at: int) -> dict | None:
        lexer = Lexer(self.data, self.data.index(b"xref", at) + 4, refs=False)
        while isinstance(first := lexer.next(), int):
            count = lexer.next()
            if not isinstance(count, int):
                return None
            for number in range(first, first + count):
                if m := _ENTRY.match(self.data, lexer.at):
                    offset, kind, lexer.at = int(m[1]), m[2].decode(), m.end()
                else:
                    offset, _, kind = lexer.next(), lexer.next(), lexer.next()
                if kind == "n" and isinstance(offset, int) and not self._known(number):
                    self.offsets[number] = offset
        if first != "trailer":
            return None
        lexer.refs = True
        info = lexer.next()
        return info if isinstance(info, dict) else None

    def _xref_stream(self, at: int) -> dict | None:
        if not (m := _HEADER.search(self.data, max(0, at - 8), at + 64)):
            return None
        got = self._object_at(m.start())
        if not isinstance(got, Stream) or got.info.get("Type") != "XRef":
            return None
        widths = [int(w) for w in got.info.get("W", [1, 2, 1])]
        rows, size = self.decoded(got), sum(widths)
        index = got.info.get("Index") or [0, int(got.info.get("Size", 0))]
        numbers = [n for first, count in zip(index[::2], index[1::2], strict=False) for n in range(int(first), int(first) + int(count))]
        for i, number in enumerate(numbers):
            row = rows[i * size : (i + 1) * size]
            if len(row) < size or not size:
                break
            fields, k = [], 0
            for w in widths:
                fields.append(int.from_bytes(row[k : k + w], "big") if w else None)
                k += w
            kind = 1 if fields[0] is None else fields[0]
            if self._known(number):
                continue
            if kind == 1:
                self.offsets[number] = fields[1]
            elif kind == 2:
                self.packed[number] = (fields[1], fields[2] or 0)
        return got.info

    def _scan(self) -> None:
        """Repair: object headers wherever they stand."""
        for m in _HEADER.finditer(self.data):
            self.offsets.setdefault(int(m[1]), m.start())
        for m in re.finditer(rb"trailer", self.data):
            info = Lexer(self.data, m.end()).next()
            if isinstance(info, dict):
                self.trailer = {**self.trailer, **info}
        for number in list(self.offsets):
            got = self.get(Ref(number))
            if isinstance(got, Stream) and got.info.get("Type") == "ObjStm":
                for n in self._bundle(number):
                    if n not in self.offsets:
                        self.packed.setdefault(n, (number, 0))
            elif isinstance(got, dict) and got.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(number))

    # ---- objects ----

    def _object_at(self, at: int):
        m = _HEADER.search(self.data, at, at + 64)
        if not m:
            return None
        lexer = Lexer(self.data, m.end())
        value = lexer.next()
        if not isinstance(value, dict):
            return None if value is END or isinstance(value, Operator) else value
        s = re.compile(rb"[\0\t\n\f\r ]*stream(\r\n|\n|\r)?").match(self.data, lexer.at)
        if not s:
            return value
        length = value.get("Length")
        if isinstance(length, Ref):
            length = None if length.number == int(m[1]) else self.get(length)
        end = s.end() + int(length) if isinstance(length, (int, float)) else -1
        if end < 0 or not re.compile(rb"[\0\t\n\f\r ]*endstream").match(self.data, end):
            end = self.data.find(b"endstream", s.end())
            end = len(self.data) if end < 0 else end
            end -= self.data[end - 2 : end] == b"\r\n" and 2 or self.data[end - 1 : end] in (b"\n", b"\r")
        return Stream(value, self.data[s.end() : end])

    def _bundle(self, number: int) -> dict[int, object]:
        if number not in self.bundles:
            self.bundles[number] = {}
            got = self.get(Ref(number))
            if isinstance(got, Stream):
                body, first = self.decoded(got), int(self.get(got.info.get("First", 0)) or 0)
                lexer, places = Lexer(body, refs=False), []
                for _ in range(int(self.get(got.info.get("N", 0)) or 0)):
                    n, at = lexer.next(), lexer.next()
                    if not isinstance(n, int) or not isinstance(at, int):
                        break
                    places.append((n, at))
                for n, at in places:
                    self.bundles[number].setdefault(n, Lexer(body, first + at).next())
        return self.bundles[number]

    def get(self, value, default=None):
        """What a value stands for: references are followed."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return default if value is None else value
            n = value.number
            if n not in self.cache:
                self.cache[n] = None  # guards against cycles
                if n in self.offsets:
                    self.cache[n] = self._object_at(self.offsets[n])
                elif n in self.packed:
                    self.cache[n] = self._bundle(self.packed[n][0]).get(n)
            value = self.cache[n]
        return default

    def dict_of(self, value) -> dict:
        got = self.get(value)
        return got.info if isinstance(got, Stream) else got if isinstance(got, dict) else {}

    def filters(self, info: dict) -> tuple[list[str], list[dict]]:
        names = self.get(info.get("Filter", info.get("F")), [])
        parms = self.get(info.get("DecodeParms", info.get("DP")), [])
        names = [names] if isinstance(names, Name) else names if isinstance(names, list) else []
        parms = parms if isinstance(parms, list) else [parms]
        return [str(self.get(n)) for n in names], [{k: self.get(v) for k, v in self.dict_of(p).items()} for p in parms]

    def decoded(self, stream: Stream) -> bytes:
        """A stream's bytes after its filters; raw where a filter is unknown."""
        out, left = codec.decode(stream.raw, *self.filters(stream.info))
        return out if out or left else stream.raw

    @property
    def max_id(self) -> int:
        return max([0, *self.offsets, *self.packed, int(self.get(self.trailer.get("Size"), 1)) - 1])

    # ---- pages ----

    def pages(self) -> list[Page]:
        found: list[tuple[int, dict, list[dict]]] = []
        root = self.dict_of(self.trailer.get("Root"))
        if "Pages" in root:
            self._walk(root["Pages"], [], set(), found)
        pages = [self._page(i, n, info, above) for i, (n, info, above) in enumerate(found)]
        return pages or self._fallback_pages()

    def _walk(self, node, above: list[dict], seen: set, found: list) -> None:
        key = node.number if isinstance(node, Ref) else id(node)
        if key in seen or len(above) > 64:
            return
        seen.add(key)
        info = self.dict_of(node)
        kids = self.get(info.get("Kids"))
        if info.get("Type") == "Page" or (not isinstance(kids, list) and ("Contents" in info or "MediaBox" in info)):
            found.append((node.number if isinstance(node, Ref) else 0, info, above))
        elif isinstance(kids, list):
            for kid in kids:
                self._walk(kid, [info, *above], seen, found)

    def _page(self, i: int, number: int, info: dict, above: list[dict]) -> Page:
        inherited = {k: next((d[k] for d in (info, *above) if k in d), None) for k in ("MediaBox", "CropBox", "Rotate", "Resources")}
        media, crop = (self._rect(inherited[k]) for k in ("MediaBox", "CropBox"))
        rotate = self.get(inherited["Rotate"], 0)
        return Page(i, number, {**info, "Resources": inherited["Resources"]}, media or Rect(*DEFAULT_BOX), crop, int(rotate) if isinstance(rotate, (int, float)) else 0)

    def _rect(self, value) -> Rect | None:
        v = [self.get(x) for x in self.get(value, [])] if isinstance(self.get(value), list) else []
        if len(v) < 4 or not all(isinstance(x, (int, float)) for x in v[:4]):
            return None
        return Rect(float(min(v[0], v[2])), float(min(v[1], v[3])), float(max(v[0], v[2])), float(max(v[1], v[3])))

    def _fallback_pages(self) -> list[Page]:
        """Without a page tree: every stream whose beginning shows a text object."""
        pages = []
        for n in sorted({*self.offsets, *self.packed}):
            got = self.get(Ref(n))
            if isinstance(got, Stream):
                head = self.decoded(got)[:PROBE]
                if b"BT" in head and b"ET" in head and any(op in head for op in (b"Tj", b"TJ", b"Tf", b"Td", b"Tm")):
                    pages.append(Page(len(pages), n, {"Contents": Ref(n), "Resources": got.info.get("Resources")}, Rect(*DEFAULT_BOX), None, 0, True))
        return pages

    def contents(self, page: Page) -> bytes:
        """Decoded content streams, each followed by a newline."""
        out: list[bytes] = []

        def add(value, seen: frozenset) -> None:
            key = value.number if isinstance(value, Ref) else id(value)
            got = self.get(value)
            if key in seen:
                return
            if isinstance(got, Stream):
                out.append(self.decoded(got) + b"\n")
            elif isinstance(got, list):
                for x in got:
                    add(x, seen | {key})

        add(page.info.get("Contents"), frozenset())
        return b"".join(out)
