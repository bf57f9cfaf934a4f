"""Content streams: from operators to glyph, image and drawing rows.

A stack machine, so it stays procedural: one call per page, inside the task that read the document.
"""

from __future__ import annotations

import copy
import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

from ..functions import icc
from ..functions.geometry import Matrix, Rect
from . import pdffont
from .document import Document, Page
from .syntax import Name, Ref, Stream, operations

# Limits of nested and of all content streams of a page, against streams that draw each other without end; where one
# stops a page, ``Output.stopped`` says so and ``pdf.errors`` reports it.
MAX_DEPTH = 32
MAX_RUNS = 2000
BLACK = 0


@dataclass
class State:
    ctm: Matrix = Matrix()
    clip: Rect | None = None
    font: pdffont.Font | None = None
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0
    fill: int = BLACK
    stroke: int = BLACK
    fill_space: object = "DeviceGray"
    stroke_space: object = "DeviceGray"
    line_width: float = 1.0
    bidi: int = 0


class Kind(NamedTuple):
    """What the glyphs of a string have in common."""

    font: pdffont.Font
    nominal: float
    char_space: float
    word_space: float
    scale: float
    along: tuple[float, float]
    to_page: Matrix
    size: float
    dx: float
    dy: float
    color: int


class Run(NamedTuple):
    """A shown string of plain codes: its glyphs are worked out for many strings at a time, by ``columns``."""

    raw: bytes
    kind: Kind
    x: float
    y: float
    seq: int
    new_obj: bool
    after_image: bool


class Moved(NamedTuple):
    """The text matrix after a string of one-byte codes, worked out when something asks for it."""

    raw: bytes
    kind: Kind | tuple
    tm: Matrix

    def settled(self) -> Matrix:
        font, size, char_space, word_space, scale = self.kind[:5]
        moved = 0.0
        for code in self.raw:
            moved += (font.advance(code) * size + char_space + (word_space if code == 32 else 0.0)) * scale
        return Matrix(1, 0, 0, 1, moved, 0) * self.tm


def settled(tm: Matrix | Moved) -> Matrix:
    return tm.settled() if isinstance(tm, Moved) else tm


@dataclass
class Output:
    #: Glyph rows and runs of glyphs, in order of emission.
    shown: list[tuple | Run] = field(default_factory=list)
    images: list[tuple] = field(default_factory=list)
    drawings: list[tuple] = field(default_factory=list)
    fonts: dict[str, pdffont.Font] = field(default_factory=dict)
    seq: int = 0
    runs: int = 0
    new_obj: bool = False
    after_image: bool = False
    #: Why content was left out, if some was.
    stopped: str | None = None

    def next(self) -> int:
        self.seq += 1
        return self.seq

    @property
    def glyphs(self) -> list[tuple]:
        """Glyph rows, in order of emission."""
        if not any(isinstance(x, Run) for x in self.shown):
            return list(self.shown)
        fonts, found = columns(self.shown)
        n = n_glyphs(self.shown)
        read = {k: np.broadcast_to(v, n).tolist() for k, v in found.items()}
        read |= {"c": list(map(chr, read["cp"])), "font": [fonts[k] for k in read["font"]]}
        return list(zip(*(read[k] for k in GLYPH_FIELDS), strict=True))


#: Columns of a glyph row after the document's id and page number.
GLYPH_FIELDS = ("seq", "c", "cp", "x", "y", "adv", "dx", "dy", "size", "asc", "dsc", "font", "color", "bold", "italic", "serif", "mono", "wmode", "bidi", "real_glyph", "new_obj", "after_image")
IMAGE_FIELDS = ("seq", "name", "obj_id", "x0", "y0", "x1", "y1", "width", "height", "bpc", "colorspace", "filter", "decode", "stream", "smask", "palette")
DRAWING_FIELDS = ("seq", "type", "path", "color", "fill", "line_width", "even_odd", "clip")


_KINDS = {**dict.fromkeys(("seq", "cp", "color", "wmode", "bidi", "font"), np.int64), **dict.fromkeys(("x", "y", "adv", "dx", "dy", "size", "asc", "dsc"), np.float64)}


def n_glyphs(shown: list[tuple | Run]) -> int:
    return sum(len(x.raw) if isinstance(x, Run) else 1 for x in shown)


def columns(shown: list[tuple | Run]) -> tuple[list[str], dict]:
    """Fonts, and the columns of glyphs by name but for ``c``; ``font`` is a place in the fonts. What is the same for all glyphs of runs alone is a scalar."""
    runs = [x for x in shown if isinstance(x, Run)]
    fonts: dict[str, int] = {}
    if len(runs) == len(shown):
        found = _run_columns(runs, fonts) if runs else {k: np.zeros(0, _KINDS.get(k, bool)) for k in GLYPH_FIELDS if k != "c"}
        return list(fonts), found
    rows = dict(zip(GLYPH_FIELDS, zip(*(x for x in shown if not isinstance(x, Run)), strict=True), strict=True))
    rows["font"] = [fonts.setdefault(f, len(fonts)) for f in rows["font"]]
    found = {k: np.array(v, _KINDS.get(k, bool)) for k, v in rows.items() if k != "c"}
    if runs:
        of_run = np.repeat([isinstance(x, Run) for x in shown], [len(x.raw) if isinstance(x, Run) else 1 for x in shown])
        for k, v in _run_columns(runs, fonts).items():
            both = np.empty(len(of_run), _KINDS.get(k, bool))
            both[of_run], both[~of_run] = v, found[k]
            found[k] = both
    return list(fonts), found


def _run_columns(runs: list[Run], fonts: dict[str, int]) -> dict:
    """Glyphs of runs: places add up along each string as for one glyph after the other."""
    codes = np.frombuffer(b"".join(r.raw for r in runs), np.uint8)
    n = np.array([len(r.raw) for r in runs])
    first = np.cumsum(n) - n
    kinds: dict[Kind, int] = {}
    of = np.array([kinds.setdefault(r.kind, len(kinds)) for r in runs])

    def spread(values: list):
        """A value for each kind as one for each glyph."""
        return values[0] if all(v == values[0] for v in values) else np.repeat(np.array(values)[of], n)

    def by_code(tables: list[np.ndarray]) -> np.ndarray:
        return tables[0][codes] if len(tables) == 1 else np.stack(tables)[np.repeat(of, n), codes]

    cp, wide, steps = [], [], ([], [])
    for k in kinds:
        extra = np.full(256, k.char_space)
        extra[32] += k.word_space
        advances = k.font.face.advances
        step = (advances * k.nominal + extra) * k.scale
        cp.append(k.font.face.cp)
        wide.append(advances + extra / k.nominal if abs(k.nominal) > 0.001 else advances)
        for to, by in zip(steps, k.along, strict=True):
            to.append(step * by)

    def moved(start: list[float], tables: list[np.ndarray]) -> np.ndarray:
        if not any(t.any() for t in tables):
            return np.repeat(np.array(start, np.float64), n)
        out = np.empty(len(codes))
        out[1:] = by_code(tables)[:-1]
        out[first] = start
        for lo, hi in zip(first.tolist(), (first + n).tolist(), strict=True):
            part = out[lo:hi]
            np.add.accumulate(part, out=part)
        return out

    x, y = moved([r.x for r in runs], steps[0]), moved([r.y for r in runs], steps[1])
    a, b, c, d, e, f = (spread([k.to_page[i] for k in kinds]) for i in range(6))
    alike = all((t == wide[0][0]).all() for t in wide)
    new_obj = np.zeros(len(codes), bool)
    new_obj[first] = [r.new_obj for r in runs]
    after_image = False
    if any(r.after_image for r in runs):
        after_image = np.zeros(len(codes), bool)
        after_image[first] = [r.after_image for r in runs]
    return {
        "seq": np.arange(len(codes)) + np.repeat(np.array([r.seq for r in runs]) - first, n), "cp": by_code(cp), "x": a * x + c * y + e, "y": b * x + d * y + f, "adv": float(wide[0][0]) if alike else by_code(wide),
        **{name: spread([getattr(k, name) for k in kinds]) for name in ("size", "dx", "dy", "color")},
        **{name: spread([getattr(k.font, of_font) for k in kinds]) for name, of_font in (("asc", "ascent"), ("dsc", "descent"), ("bold", "bold"), ("italic", "italic"), ("serif", "serif"), ("mono", "mono"))},
        "font": spread([fonts.setdefault(k.font.base_font, len(fonts)) for k in kinds]), "wmode": 0, "bidi": 0, "real_glyph": True, "new_obj": new_obj, "after_image": after_image,
    }


@functools.lru_cache(4096)
def level_of(char: str, now: int) -> int:
    """Direction level of a character; neutral ones go on with the present level."""
    kind = unicodedata.bidirectional(char)
    if kind in ("R", "AL", "AN"):
        return 1
    return now if kind in ("CS", "NSM", "BN", "B", "S", "WS", "ON") else 0


def byte(v: float) -> int:
    return int(max(0.0, min(1.0, v)) * 255 + 0.5)


def rgb(r: float, g: float, b: float) -> int:
    return byte(r) << 16 | byte(g) << 8 | byte(b)


def by_count(v: list[float]) -> int:
    if len(v) >= 4:
        c, m, y, k = v[:4]
        if k >= 0.999 and max(c, m, y) <= 0.001:
            return 35 << 16 | 31 << 8 | 32
        return rgb(*(1 - min(1.0, x + k) for x in (c, m, y)))
    return rgb(*v[:3]) if len(v) == 3 else rgb(v[0], v[0], v[0]) if v else BLACK


#: Operators without effect outside of text objects.
_IN_TEXT = frozenset(("Td", "TD", "Tm", "T*", "Tj", "'", '"', "TJ"))


class Interpreter:
    def __init__(self, doc: Document, page: Page, cmap_folder: str | None = None, glyph_list: dict[str, int] | None = None, loaded: dict | None = None, max_runs: int = MAX_RUNS, max_depth: int = MAX_DEPTH):
        self.doc, self.page, self.out = doc, page, Output()
        self.max_runs, self.max_depth = max_runs, max_depth
        self.folder, self.glyph_list = cmap_folder, glyph_list
        self.loaded = {} if loaded is None else loaded
        self.to_page = page.matrix
        self.last_shape: tuple = (None, (1.0, 1.0, 0.0))

    def run(self) -> Output:
        self._stream(self.doc.contents(self.page), self.doc.dict_of(self.page.info.get("Resources")), State(), 0)
        return self.out

    # ---- resources ----

    def _resource(self, resources: dict, kind: str, name: str):
        return self.doc.dict_of(resources.get(kind)).get(name)

    def _font(self, resources: dict, name: str) -> pdffont.Font | None:
        ref = self._resource(resources, "Font", name)
        if ref is None:
            return None
        key = ref.number if isinstance(ref, Ref) else id(ref)
        if key not in self.loaded:
            self.loaded[key] = pdffont.load(self.doc, ref, self.folder, self.glyph_list)
        self.out.fonts.setdefault(name, self.loaded[key])
        return self.loaded[key]

    # ---- colours ----

    def _space(self, resources: dict, value, depth: int = 0):
        """A colour space, resolved: a name, or a list whose parts are looked up."""
        value = self.doc.get(value)
        if isinstance(value, Name) and not str(value).startswith("Device") and depth < 10:
            named = self._resource(resources, "ColorSpace", value)
            if named is not None:
                return self._space(resources, named, depth + 1)
        return value

    def _color(self, space, v: list[float], depth: int = 0) -> int:
        if isinstance(space, list) and space and depth < 10:
            kind, get = str(self.doc.get(space[0])), self.doc.get
            if kind == "ICCBased":
                n, profile = int(get(self.doc.dict_of(space[1]).get("N"), len(v))), self._profile(space[1])
                return rgb(*profile.rgb(v)) if profile and n == 3 and len(v) >= 3 else by_count(v[:n])
            if kind in ("Separation", "DeviceN") and len(space) > 3:
                made = self._function(space[3], v)
                return self._color(get(space[2]), made, depth + 1) if made else rgb(*[1 - (v[0] if v else 0)] * 3)
            if kind == "Lab" and len(v) >= 3:
                return self._lab(v)
            if kind == "Indexed" and len(space) > 3 and v:
                base, table = get(space[1]), get(space[3])
                raw = self.doc.decoded(table) if isinstance(table, Stream) else table if isinstance(table, bytes) else b""
                n = self._components(base)
                return self._color(base, [b / 255 for b in raw[int(v[0]) * n : int(v[0]) * n + n]], depth + 1)
            if kind == "Pattern" and len(space) > 1:
                return self._color(get(space[1]), v, depth + 1)
        return by_count(v)

    def _profile(self, ref) -> icc.Profile | None:
        key = ("icc", ref.number if isinstance(ref, Ref) else id(ref))
        if key not in self.loaded:
            got = self.doc.get(ref)
            self.loaded[key] = icc.parse(self.doc.decoded(got)) if isinstance(got, Stream) else None
        return self.loaded[key]

    def _components(self, space) -> int:
        if isinstance(space, list) and space:
            kind = str(self.doc.get(space[0]))
            if kind == "ICCBased":
                return int(self.doc.get(self.doc.dict_of(space[1]).get("N"), 3))
            return {"CalGray": 1, "Separation": 1, "Indexed": 1}.get(kind, 3)
        return {"DeviceGray": 1, "G": 1, "DeviceCMYK": 4, "CMYK": 4}.get(str(space), 3)

    @staticmethod
    def _lab(v: list[float]) -> int:
        fy = (v[0] + 16) / 116
        x, y, z = (w * (t**3 if t > 6 / 29 else 3 * (6 / 29) ** 2 * (t - 4 / 29)) for w, t in ((0.9642, fy + v[1] / 500), (1.0, fy), (0.8249, fy - v[2] / 200)))
        linear = (3.1338561 * x - 1.6168667 * y - 0.4906146 * z, -0.9787684 * x + 1.9161415 * y + 0.0334540 * z, 0.0719453 * x - 0.2289914 * y + 1.4052427 * z)
        return rgb(*(12.92 * t if t <= 0.0031308 else 1.055 * t ** (1 / 2.4) - 0.055 for t in linear))

    def _function(self, value, v: list[float]) -> list[float]:
        """Function of type 2 (power) or 0 (samples of one input)."""
        got = self.doc.get(value)
        info = self.doc.dict_of(value)
        t = max(0.0, min(1.0, v[0] if v else 0.0))
        numbers = lambda key, default: [float(self.doc.get(x)) for x in self.doc.get(info.get(key), default)]
        if info.get("FunctionType") == 2:
            c0, c1, n = numbers("C0", [0.0]), numbers("C1", [1.0]), float(self.doc.get(info.get("N"), 1))
            return [a + t**n * (b - a) for a, b in zip(c0, c1, strict=False)]
        if info.get("FunctionType") == 0 and isinstance(got, Stream) and len(v) == 1:
            bits, size, span = int(self.doc.get(info.get("BitsPerSample"), 8)), int(numbers("Size", [2])[0]), numbers("Range", [])
            n, raw = len(span) // 2, self.doc.decoded(got)
            if bits % 8 or not n or size < 1:
                return []
            width, place = bits // 8, t * (size - 1)
            low = min(int(place), max(0, size - 2))

            def sample(i: int, k: int) -> float:
                at = (min(i, size - 1) * n + k) * width
                return span[2 * k] + int.from_bytes(raw[at : at + width], "big") / ((1 << bits) - 1) * (span[2 * k + 1] - span[2 * k])

            return [sample(low, k) + (sample(low + 1, k) - sample(low, k)) * (place - low) for k in range(n)]
        return []

    # ---- streams ----

    def _operations(self, data: bytes) -> Iterator[tuple[str, list]]:
        return operations(data)

    def _stream(self, data: bytes, resources: dict, state: State, depth: int) -> None:
        self.out.runs += 1
        if depth > self.max_depth:
            self.out.stopped = f"content streams nested deeper than {self.max_depth} left out"
            return
        if self.out.runs > self.max_runs:
            self.out.stopped = f"content streams after the first {self.max_runs} left out"
            return
        st, stack = state, []
        tm = tlm = Matrix()
        inside, path, pending_clip = False, [], None
        actual: list[list[int]] = []
        here = (0.0, 0.0)
        num = lambda ops, n: [float(x) for x in ops[-n:]] if len(ops) >= n and all(isinstance(x, (int, float)) for x in ops[-n:]) else None

        for op, ops in self._operations(data):
            if op in _IN_TEXT:
                if not inside:
                    continue
                if op in ("Td", "TD"):
                    if v := num(ops, 2):
                        st.leading = -v[1] if op == "TD" else st.leading
                        tm = tlm = Matrix(1, 0, 0, 1, *v) * tlm
                elif op == "Tm":
                    if v := num(ops, 6):
                        tm = tlm = Matrix(*v)
                elif op == "T*":
                    tm = tlm = Matrix(1, 0, 0, 1, 0, -st.leading) * tlm
                elif op in ("Tj", "'", '"', "TJ") and ops:
                    if op in ("'", '"'):
                        if op == '"' and (v := num(ops[:-1], 2)):
                            st.word_space, st.char_space = v
                        tm = tlm = Matrix(1, 0, 0, 1, 0, -st.leading) * tlm
                    for part in ops[-1] if op == "TJ" and isinstance(ops[-1], list) else [ops[-1]]:
                        tm = settled(tm)
                        if isinstance(part, bytes):
                            tm = self._show(part, st, tm, actual)
                        elif isinstance(part, (int, float)):
                            skip = -part / 1000 * st.size
                            tm = (Matrix(1, 0, 0, 1, 0, skip) if st.font and st.font.wmode else Matrix(1, 0, 0, 1, skip * st.scale, 0)) * tm
            elif op == "BT":
                inside, tm, tlm, st.bidi, self.out.new_obj = True, Matrix(), Matrix(), 0, True
            elif op == "ET":
                inside = False
            elif op == "q":
                stack.append(copy.copy(st))
            elif op == "Q":
                st = stack.pop() if stack else st
            elif op == "cm":
                if v := num(ops, 6):
                    st.ctm = Matrix(*v) * st.ctm
            elif op in ("m", "l"):
                if v := num(ops, 2):
                    path.append((op, (here := (v[0], v[1]),)))
            elif op in ("c", "v", "y"):
                if v := num(ops, 6 if op == "c" else 4):
                    p = list(zip(v[::2], v[1::2], strict=True))
                    p = p if op == "c" else [here, *p] if op == "v" else [p[0], p[1], p[1]]
                    path.append(("c", tuple(p)))
                    here = p[-1]
            elif op == "h":
                path.append(("h", ()))
            elif op == "re":
                if v := num(ops, 4):
                    x, y, w, h = v
                    path += [("m", ((x, y),)), ("l", ((x + w, y),)), ("l", ((x + w, y + h),)), ("l", ((x, y + h),)), ("h", ())]
            elif op in ("W", "W*"):
                pending_clip = op
            elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                self._paint(op, path, st)
                if pending_clip and (box := self._path_box(path, st)):
                    st.clip = st.clip & box if st.clip else box
                path, pending_clip = [], None
            elif op == "w":
                if v := num(ops, 1):
                    st.line_width = v[0]
            elif op == "Do" and ops and isinstance(ops[-1], Name):
                self._xobject(self._resource(resources, "XObject", ops[-1]), str(ops[-1]), resources, st, depth)
            elif op in ("BDC", "DP"):
                if actual and actual[-1]:
                    self._leftovers(actual[-1], st, tm)
                text = self._actual_text(ops, resources)
                if op == "BDC":
                    actual.append(text)
                elif text:
                    self._leftovers(text, st, tm)
            elif op == "BMC":
                actual.append([])
            elif op == "EMC":
                if actual and (left := actual.pop()):
                    self._leftovers(left, st, tm)
            elif op == "Tf" and len(ops) >= 2 and isinstance(ops[-2], Name):
                st.font, st.size = self._font(resources, ops[-2]), float(ops[-1]) if isinstance(ops[-1], (int, float)) else st.size
            elif op in ("Tc", "Tw", "TL", "Ts", "Tz", "Tr"):
                if v := num(ops, 1):
                    if op == "Tz":
                        st.scale = v[0] / 100
                    elif op == "Tr":
                        st.mode = max(0, min(7, int(v[0])))
                    else:
                        setattr(st, {"Tc": "char_space", "Tw": "word_space", "TL": "leading", "Ts": "rise"}[op], v[0])
            elif op in ("cs", "CS") and ops:
                setattr(st, "fill_space" if op == "cs" else "stroke_space", self._space(resources, ops[-1]))
                setattr(st, "fill" if op == "cs" else "stroke", BLACK)
            elif op in ("sc", "scn", "SC", "SCN"):
                v = [float(x) for x in ops if isinstance(x, (int, float))]
                which = "fill" if op[0] == "s" else "stroke"
                if v:
                    setattr(st, which, self._color(getattr(st, f"{which}_space"), v))
            elif op in ("g", "rg", "k", "G", "RG", "K"):
                n = {"g": 1, "rg": 3, "k": 4}[op.lower()]
                if v := num(ops, n):
                    which = "fill" if op.islower() else "stroke"
                    setattr(st, which, by_count(v))
                    setattr(st, f"{which}_space", {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[n])
        for left in reversed(actual):
            if left:
                self._leftovers(left, st, tm)

    # ---- text ----

    @staticmethod
    def _first(st: State, along: Matrix) -> Matrix:
        """Place of a string's first glyph."""
        return Matrix(st.size * st.scale, 0, 0, st.size, 0, st.rise) * along

    def _placed(self, raw: bytes, st: State, tm: Matrix) -> tuple[list[tuple[int, int, float, Matrix]], Matrix]:
        """Codes of a shown string with their length, advance and place, and the text matrix after them.

        Within a string only the origin moves, along the text matrix' own axis.
        """
        font, size = st.font or pdffont.Font(widths={}), st.size
        along = tm * st.ctm
        a, b, c, d, x, y = self._first(st, along)
        ux, uy = (along.c, along.d) if font.wmode else (along.a, along.b)
        out, moved = [], 0.0
        for code, n in font.codes(raw):
            adv = font.advance(code)
            extra = st.char_space + (st.word_space if code == 32 and n <= 2 else 0.0)
            wide = adv + extra / size if abs(size) > 0.001 else adv
            if font.wmode:
                _, vx, vy = font.vertical.get(code, font.vertical.get(-1, (-1.0, font.widths.get(code, font.default_width or 1.0) / 2, 0.88)))
                out.append((code, n, wide, Matrix(a, b, c, d, x - vx * a - vy * c, y - vx * b - vy * d)))
                step = -(adv * size + extra)
            else:
                out.append((code, n, wide, Matrix(a, b, c, d, x, y)))
                step = (adv * size + extra) * st.scale
            x, y, moved = x + step * ux, y + step * uy, moved + step
        return out, (Matrix(1, 0, 0, 1, 0, moved) if font.wmode else Matrix(1, 0, 0, 1, moved, 0)) * tm

    @staticmethod
    def _advances(raw: bytes, font: pdffont.Font, st: State) -> tuple[np.ndarray, np.ndarray]:
        """Of a string in a simple font: advances, and how far each moves the pen."""
        codes = np.frombuffer(raw, np.uint8)
        adv = font.face.advances[codes]
        extra = np.where(codes == 32, st.char_space + st.word_space, st.char_space) if st.word_space else st.char_space
        return adv + extra / st.size if abs(st.size) > 0.001 else adv, (adv * st.size + extra) * st.scale

    def _places(self, raw: bytes, font: pdffont.Font, st: State, tm: Matrix) -> tuple[np.ndarray, Matrix, np.ndarray, np.ndarray]:
        """As ``_placed``, of a simple font and on arrays: advances, the first code's place, and the origins of all."""
        along = tm * st.ctm
        at = self._first(st, along)
        adv, step = self._advances(raw, font, st)
        x, y = (np.add.accumulate(np.concatenate(([start], (step * by)[:-1]))) for start, by in ((at.e, along.a), (at.f, along.b)))
        return adv, at, x, y

    def _run(self, raw: bytes, st: State, tm: Matrix) -> Moved:
        """Show a string of plain codes outside of clips and replacement texts."""
        along, out = tm * st.ctm, self.out
        at = self._first(st, along)
        kind = Kind(st.font, st.size, st.char_space, st.word_space, st.scale, (along.a, along.b), self.to_page, *self._shape(at, st.size, 0), st.stroke if st.mode in (1, 5) else st.fill)
        out.shown.append(Run(raw, kind, at.e, at.f, out.seq + 1, out.new_obj, out.after_image))
        out.seq += len(raw)
        out.new_obj = out.after_image = False
        return Moved(raw, kind, tm)

    def _show(self, raw: bytes, st: State, tm: Matrix, actual: list[list[int]]) -> Matrix | Moved:
        font = st.font or pdffont.Font(widths={})
        if raw and st.font and not (actual and actual[-1]) and not st.clip and not st.bidi and not raw.translate(None, font.face.plain):
            return self._run(raw, st, tm)
        placed, tm = self._placed(raw, st, tm)
        shown = [(font.characters(code), wide, at) for code, _, wide, at in placed]
        told = actual[-1] if actual else []
        if not told:
            for seq, adv, at in shown:
                for k, cp in enumerate(seq):
                    self._emit(cp, 0.0 if k else adv, at, st, k == 0)
            return tm
        self._show_actual(shown, told, st)
        return tm

    def _show_actual(self, shown: list, told: list[int], st: State) -> None:
        """Glyphs take their characters from the replacement text: equal ends stay as they are, what is between is dealt out in order."""
        first = [seq[0] for seq, _, _ in shown]
        head = 0
        while head < min(len(first), len(told)) and first[head] == told[head]:
            head += 1
        for seq, adv, at in shown[:head]:
            self._emit(seq[0], adv, at, st, True)
        if head == len(shown):
            del told[:head]
            return
        tail = 0
        while tail < min(len(first), len(told)) - head and first[-1 - tail] == told[-1 - tail]:
            tail += 1
        middle = told[head : len(told) - tail]
        for i, (seq, adv, at) in enumerate(shown[head : len(shown) - tail]):
            self._emit(middle[i] if i < len(middle) else seq[0], adv, at, st, i < len(middle))
        used = len(shown) - tail - head
        if tail == 0:  # the text may go on in the next string
            del told[: head + min(used, len(middle))]
            return
        if len(middle) > used:
            adv, at = shown[len(shown) - tail - 1][1:] if len(shown) > tail else (0.0, shown[0][2])
            for cp in middle[used:]:
                self._emit(cp, 0.0, Matrix(1, 0, 0, 1, adv, 0) * at, st, False)
        for seq, adv, at in shown[len(shown) - tail :]:
            self._emit(seq[0], adv, at, st, True)
        told.clear()

    def _leftovers(self, text: list[int], st: State, tm: Matrix) -> None:
        at = Matrix(st.size * st.scale, 0, 0, st.size, 0, st.rise) * settled(tm) * st.ctm
        for cp in text:
            self._emit(cp, 0.0, at, st, False)
        text.clear()

    def _actual_text(self, ops: list, resources: dict) -> list[int]:
        info = ops[-1] if ops else None
        if isinstance(info, Name):
            info = self.doc.dict_of(self._resource(resources, "Properties", info))
        raw = self.doc.get(info.get("ActualText")) if isinstance(info, dict) else None
        return [ord(c) for c in text_string(raw)] if isinstance(raw, bytes) else []

    def _shape(self, at: Matrix, nominal: float, wmode: int) -> tuple[float, float, float]:
        """Size and direction in page space; equal for all glyphs of a string."""
        key = (at[:4], nominal, wmode)
        if key != self.last_shape[0]:
            m = at * self.to_page
            size = m.expansion if m.expansion > 0.001 else nominal if nominal > 0.001 else 1.0
            ux, uy = (-m.c, -m.d) if wmode else (m.a, m.b)
            length = (ux * ux + uy * uy) ** 0.5 or 1.0
            self.last_shape = (key, (size, ux / length, uy / length))
        return self.last_shape[1]

    def _emit(self, cp: int, adv: float, at: Matrix, st: State, real: bool) -> None:
        if cp in (-1, 10, 13):
            return
        font = st.font or pdffont.Font()
        if st.clip and self._clipped(at, adv, font, st.clip):
            return
        size, dx, dy = self._shape(at, st.size, font.wmode)
        x, y = self.to_page.at(at.e, at.f)
        color, out = st.stroke if st.mode in (1, 5) else st.fill, self.out
        for k, c in enumerate(expand(cp)):
            st.bidi = level_of(c, st.bidi)
            out.seq += 1
            out.shown.append((
                out.seq, c, ord(c), x, y, 0.0 if k else adv, dx, dy, size, font.ascent, font.descent, font.base_font,
                color, font.bold, font.italic, font.serif, font.mono, font.wmode, st.bidi, real and not k, out.new_obj, out.after_image,
            ))
            out.new_obj = out.after_image = False

    @staticmethod
    def _clipped(at: Matrix, adv: float, font: pdffont.Font, clip: Rect) -> bool:
        """Whether a glyph's box lies wholly outside."""
        b = at.box(Rect(0.0, font.descent, adv, font.ascent))
        return b.x1 <= clip.x0 or b.x0 >= clip.x1 or b.y1 <= clip.y0 or b.y0 >= clip.y1

    # ---- graphics ----

    def _path_box(self, path: list, st: State) -> Rect | None:
        points = [st.ctm.at(*p) for _, ps in path for p in ps]
        if not points:
            return None
        xs, ys = zip(*points, strict=True)
        return Rect(min(xs), min(ys), max(xs), max(ys))

    def _paint(self, op: str, path: list, st: State) -> None:
        if not path or op == "n":
            return
        m = st.ctm * self.to_page
        closed = path + [("h", ())] if op in ("s", "b", "b*") else path
        shape = [{"cmd": cmd, "points": [{"x": p[0], "y": p[1]} for p in (m.at(*q) for q in ps)]} for cmd, ps in closed]
        kind = "s" if op in "Ss" else "f" if op[0] in "fF" else "fs"
        clip = self.to_page.box(st.clip) if st.clip else None
        self.out.drawings.append((self.out.next(), kind, shape, st.stroke if kind != "f" else None, st.fill if kind != "s" else None, st.line_width * st.ctm.expansion, op.endswith("*"), dict(zip(("x0", "y0", "x1", "y1"), clip, strict=True)) if clip else None))

    def _xobject(self, ref, name: str, resources: dict, st: State, depth: int) -> None:
        got = self.doc.get(ref)
        if not isinstance(got, Stream):
            return
        if got.info.get("Subtype") == "Image":
            self._image(ref, got, name if depth == 0 else "form_child", resources, st)
        elif got.info.get("Subtype") == "Form":
            v = [self.doc.get(x) for x in self.doc.get(got.info.get("Matrix"), [])]
            inner = copy.copy(st)
            if len(v) == 6:
                inner.ctm = Matrix(*map(float, v)) * st.ctm
            own = self.doc.dict_of(got.info.get("Resources"))
            merged = {**resources, **{k: {**self.doc.dict_of(resources.get(k)), **self.doc.dict_of(x)} if isinstance(self.doc.get(x), dict) else x for k, x in own.items()}}
            self._form(ref, got, merged, inner, depth + 1)

    def _form(self, ref, got: Stream, resources: dict, st: State, depth: int) -> None:
        self._stream(self.doc.decoded(got), resources, st, depth)

    def _image(self, ref, got: Stream, name: str, resources: dict, st: State) -> None:
        info, get = got.info, self.doc.get
        box = (st.ctm * self.to_page).box(Rect(0, 0, 1, 1))
        space = self._space(resources, info.get("ColorSpace", info.get("CS")))
        palette = None
        if isinstance(space, list) and str(get(space[0])) == "Indexed" and len(space) > 3:
            table = get(space[3])
            palette = self.doc.decoded(table) if isinstance(table, Stream) else table
        names, parms = self.doc.filters(info)
        from . import codec

        data, left = codec.decode(got.raw, names, parms)
        mask = get(info.get("SMask"))
        self.out.images.append((
            self.out.next(), name, ref.number if isinstance(ref, Ref) else 0, *box, int(get(info.get("Width"), 0)), int(get(info.get("Height"), 0)), int(get(info.get("BitsPerComponent"), 8)),
            str(get(space[0])) if isinstance(space, list) and space else str(space or ""), left or (names[-1] if names else ""), [float(get(x)) for x in get(info.get("Decode"), [])],
            data, self.doc.decoded(mask) if isinstance(mask, Stream) else None, palette,
        ))
        self.out.after_image = True


@functools.lru_cache(4096)
def expand(cp: int) -> str:
    """Ligatures and presentation forms as their plain characters; blanks of all kinds as a blank."""
    from ..functions.text import BLANKS

    c = chr(cp if 0 < cp <= 0x10FFFF and not 0xD800 <= cp <= 0xDFFF else 0xFFFD)
    if c in BLANKS:
        return " "
    if 0xFB00 <= cp <= 0xFDFF or 0xFE70 <= cp <= 0xFEFC:
        return unicodedata.normalize("NFKC", c)
    return c


def text_string(raw: bytes) -> str:
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw[2:].decode("utf-16-be" if raw[0] == 0xFE else "utf-16-le", "replace")
    return raw.decode("cp1252", "replace")
