"""Fonts: codes to Unicode, widths, metrics and style, from font dictionaries."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path
from typing import NamedTuple

import numpy as np

from ..functions import fonts as rules
from .document import Document
from .syntax import END, Lexer, Name, Operator, Ref, Stream

# Combining marks by the ends of glyph names.
ACCENTS = {"acute": 0x301, "grave": 0x300, "circumflex": 0x302, "dieresis": 0x308, "tilde": 0x303, "ring": 0x30A, "cedilla": 0x327, "caron": 0x30C, "macron": 0x304, "breve": 0x306, "ogonek": 0x328, "dotaccent": 0x307, "hungarumlaut": 0x30B}

# Glyph names that no rule gives.
NAMED = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±",
    "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿",
    "AE": "Æ", "ae": "æ", "Eth": "Ð", "eth": "ð", "Oslash": "Ø", "oslash": "ø", "Thorn": "Þ", "thorn": "þ", "germandbls": "ß", "multiply": "×", "divide": "÷", "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "OE": "Œ", "oe": "œ", "florin": "ƒ",
    "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "tilde": "˜", "hungarumlaut": "˝", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„",
    "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›", "fraction": "⁄", "Euro": "€", "trademark": "™", "minus": "−", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ",
}

# Where the standard encoding differs from ASCII and Latin-1.
STANDARD = {
    0x27: "’", 0x60: "‘", **dict(zip(range(0xA1, 0xB0), "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ", strict=True)), 0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿",
    0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜", 0xC5: "¯", 0xC6: "˘", 0xC7: "˙", 0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß",
}

# What the letters of the Symbol font stand for, A to Z and a to z.
SYMBOL_UPPER = "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ"
SYMBOL_LOWER = "αβχδεφγηιϕκλμνοπθρστυϖωξψζ"

# Dingbats codes that do not follow U+2701 onwards.
DINGBATS = {0x20: 0x20, 0x25: 0x260E, 0x2A: 0x261B, 0x2B: 0x261E, 0x48: 0x2605, 0x6C: 0x25CF, 0x6E: 0x25A0, 0x73: 0x25B2, 0x74: 0x25BC, 0x75: 0x25C6, 0x77: 0x25D7}

REPLACEMENT = 0xFFFD


def symbolic_table(name: str) -> dict[int, int]:
    """Codes of the two standard picture fonts."""
    lower = name.lower()
    if "dingbats" in lower:
        return {c: 0x2701 + c - 0x21 for c in range(0x21, 0x7F)} | DINGBATS
    if "symbol" in lower:
        return {65 + i: ord(c) for i, c in enumerate(SYMBOL_UPPER)} | {97 + i: ord(c) for i, c in enumerate(SYMBOL_LOWER)}
    return {}


def encoding_table(name: str) -> dict[int, int]:
    """Codes to code points of a named base encoding."""
    if name == "StandardEncoding":
        return {c: c for c in range(32, 127)} | {k: ord(v) for k, v in STANDARD.items()}
    codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(name)
    if codec is None:
        return {}
    return {c: ord(t) for c in range(32, 256) if (t := bytes([c]).decode(codec, "ignore"))}


def glyph_name_to_unicode(name: str, glyph_list: dict[str, int] | None = None) -> int:
    """Code point of a glyph name; 0 if unknown.  ``glyph_list`` has names beyond the rules."""
    name = name.split(".")[0]
    joined = name.replace("_", "")
    if joined in ("fi", "fl", "ffi", "ffl"):
        return ord(NAMED[joined])
    if "_" in name and name[:1] != "f":
        name = name.split("_")[0]
    if glyph_list and name in glyph_list:
        return glyph_list[name]
    if name in NAMED:
        return ord(NAMED[name])
    if len(name) == 1:
        return ord(name)
    if m := re.fullmatch(r"([A-Za-z])(" + "|".join(ACCENTS) + ")", name):
        one = unicodedata.normalize("NFC", m[1] + chr(ACCENTS[m[2]]))
        return ord(one) if len(one) == 1 else 0
    if m := re.match(r"uni([0-9A-Fa-f]{4})", name) or re.fullmatch(r"u([0-9A-Fa-f]{4,6})", name):
        return int(m[1], 16)
    if m := re.fullmatch(r"[ag]?(\d{1,7})", name):
        return int(m[1])
    size = "CAPITAL" if name[:1].isupper() else "SMALL"
    try:
        return ord(unicodedata.lookup(f"GREEK {size} LETTER {name}"))
    except KeyError:
        return 0


def read_glyph_list(path: str) -> dict[str, int]:
    """A glyph list file of lines ``name;HEX``."""
    lines = (line.strip().split(";") for line in Path(path).read_text("latin-1").splitlines() if ";" in line and not line.startswith("#"))
    return {n: int(h.split()[0], 16) for n, h in lines if " " not in h.strip()}


@dataclass
class CMap:
    """Code ranges and what codes stand for (code points, or CIDs)."""

    spaces: list[tuple[int, int, int]] = field(default_factory=list)  # bytes, low, high
    chars: dict[int, list[int]] = field(default_factory=dict)
    cids: dict[int, int] = field(default_factory=dict)


def _utf16(raw: bytes) -> list[int]:
    if len(raw) == 1:
        return [raw[0]]
    return [ord(c) for c in raw.decode("utf-16-be", "replace")]


def parse_cmap(data: bytes, base: CMap | None = None, folder: str | None = None) -> CMap:
    """A CMap's text; one that looks binary is empty.  Predefined ones are read from ``folder``."""
    out = base or CMap()
    if sum(c < 9 or 13 < c < 32 or c > 126 for c in data[:64]) > 16:
        return out
    lexer, stack = Lexer(data, refs=False), []
    while (x := lexer.next()) is not END:
        if not isinstance(x, Operator):
            stack.append(x)
            continue
        if x == "usecmap" and stack and isinstance(stack[-1], Name):
            more = predefined(str(stack[-1]), folder)
            out.spaces += more.spaces
            out.chars = more.chars | out.chars
            out.cids = more.cids | out.cids
        elif x == "endcodespacerange":
            out.spaces += [(len(a), int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in zip(stack[::2], stack[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)]
        elif x in ("endbfchar", "endcidchar"):
            for a, b in zip(stack[::2], stack[1::2], strict=False):
                if isinstance(a, bytes):
                    code = int.from_bytes(a, "big")
                    if isinstance(b, bytes):
                        out.chars[code] = _utf16(b)
                    elif isinstance(b, Name):
                        out.chars[code] = [glyph_name_to_unicode(b)]
                    elif isinstance(b, int):
                        out.cids[code] = b
        elif x in ("endbfrange", "endcidrange"):
            for a, b, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                if isinstance(a, bytes) and isinstance(b, bytes):
                    _range(out, int.from_bytes(a, "big"), min(int.from_bytes(b, "big"), int.from_bytes(a, "big") + 65535), to)
        if x.startswith(("begin", "end", "use", "def")) or x in ("pop", "dup", "findresource"):
            stack = []
    out.spaces = sorted(set(out.spaces), key=lambda s: (-s[0], s[1], s[2]))
    return out


def _range(out: CMap, low: int, high: int, to) -> None:
    if isinstance(to, bytes):
        first = _utf16(to)
        for i in range(high - low + 1 if first else 0):
            out.chars[low + i] = [*first[:-1], first[-1] + i]
    elif isinstance(to, list):
        for i, one in enumerate(to[: high - low + 1]):
            if isinstance(one, bytes):
                out.chars[low + i] = _utf16(one)
    elif isinstance(to, int):
        for i in range(high - low + 1):
            out.cids[low + i] = to + i


_PREDEFINED: dict[tuple[str, str | None], CMap] = {}


def predefined(name: str, folder: str | None) -> CMap:
    """A CMap by name: Identity, or a file of that name anywhere under ``folder``."""
    if name.startswith("Identity"):
        return CMap([(2, 0, 0xFFFF)])
    if (name, folder) not in _PREDEFINED:
        path = next(iter(sorted(Path(folder).rglob(name))), None) if folder else None
        _PREDEFINED[name, folder] = parse_cmap(path.read_bytes(), None, folder) if path else CMap()
    return _PREDEFINED[name, folder]


class Face(NamedTuple):
    """What the codes of a font with codes of one byte stand for, by code; all are ``plain`` that show one glyph of one left-to-right character."""

    plain: bytes
    cp: np.ndarray
    advances: np.ndarray


@dataclass(eq=False)
class Font:
    obj_id: int = 0
    base_font: str = ""
    unicode: dict[int, list[int]] = field(default_factory=dict)
    spaces: list[tuple[int, int, int]] = field(default_factory=list)
    code_bytes: int = 1
    widths: dict[int, float] = field(default_factory=dict)
    default_width: float | None = None
    vertical: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    wmode: int = 0
    ascent: float = 0.8
    descent: float = -0.2
    bold: bool = False
    italic: bool = False
    serif: bool = True
    mono: bool = False
    known: dict[int, list[int]] = field(default_factory=dict, repr=False)

    @property
    def is_simple(self) -> bool:
        """Horizontal, every byte a code."""
        return self.code_bytes == 1 and not self.spaces and self.wmode == 0

    @cached_property
    def face(self) -> Face:
        from .interpreter import expand, level_of

        shown = [self.characters(code) if self.is_simple else [] for code in range(256)]
        texts = [expand(seq[0]) if len(seq) == 1 and seq[0] not in (-1, 10, 13) else "" for seq in shown]
        plain = bytes(code for code, t in enumerate(texts) if len(t) == 1 and not level_of(t, 0))
        return Face(plain, np.array([ord(t[0]) if t else 0 for t in texts]), np.array([self.advance(code) for code in range(256)]))

    def codes(self, raw: bytes):
        """(code, number of bytes) of a shown string: the longest code range that fits, else one byte."""
        if self.code_bytes == 1 and not self.spaces:
            yield from ((c, 1) for c in raw)
            return
        at, widest = 0, max([self.code_bytes, *(s[0] for s in self.spaces)])
        while at < len(raw):
            code, n = raw[at], 1
            room = min(widest, len(raw) - at)
            if room > 1 and self.spaces:
                for k in range(room, 0, -1):
                    value = int.from_bytes(raw[at : at + k], "big")
                    if any(s == k and low <= value <= high for s, low, high in self.spaces):
                        code, n = value, k
                        break
            elif room > 1:
                code, n = int.from_bytes(raw[at : at + room], "big"), room
            yield code, n
            at += n

    def advance(self, code: int) -> float:
        if self.wmode == 1:
            return abs(self.vertical.get(code, self.vertical.get(-1, (-1.0, 0.0, 0.88)))[0])
        w = self.widths.get(code, self.default_width)
        return w if w is not None else 0.33 if code == 32 else 0.55

    def characters(self, code: int) -> list[int]:
        """Code points of a code: C1 controls read as Windows Latin, other controls as blanks; unknown codes stand for themselves."""
        if code not in self.known:
            self.known[code] = [_clean(v) for v in self.unicode.get(code) or [code]]
        return self.known[code]


def _clean(cp: int) -> int:
    if 8 <= cp <= 13:
        return 32
    if 128 <= cp <= 159:
        from ..functions.text import WIN_LATIN

        return WIN_LATIN[cp - 128] or cp
    return cp if 0 < cp <= 0x10FFFF else REPLACEMENT


def usable(seq: list[int]) -> bool:
    return bool(seq) and not any(v < 32 and v not in (9, 10, 13) for v in seq)


def _number(doc: Document, value, default=None):
    got = doc.get(value)
    return float(got) if isinstance(got, (int, float)) and not isinstance(got, bool) else default


#: Fonts that are told by direct values only, which many documents share, and how many of them are kept.
_SHARED: dict[tuple, Font] = {}
SHARED = 256


def load(doc: Document, ref, cmap_folder: str | None = None, glyph_list: dict[str, int] | None = None) -> Font:
    """All that showing text needs to know of a font."""
    info = doc.dict_of(ref)
    if glyph_list or not all(isinstance(v, (Name, int, float)) for v in info.values()):
        return _loaded(doc, ref, info, cmap_folder, glyph_list)
    key = (ref.number if isinstance(ref, Ref) else 0, cmap_folder, *((k, type(v), v) for k, v in sorted(info.items())))
    if key not in _SHARED:
        if len(_SHARED) >= SHARED:
            _SHARED.clear()
        _SHARED[key] = _loaded(doc, ref, info, cmap_folder, glyph_list)
    return _SHARED[key]


def _loaded(doc: Document, ref, info: dict, cmap_folder: str | None, glyph_list: dict[str, int] | None) -> Font:
    font = Font(ref.number if isinstance(ref, Ref) else 0, re.sub(r"^[^+]{1,7}\+", "", str(doc.get(info.get("BaseFont"), ""))))
    composite = info.get("Subtype") == "Type0"
    below = doc.get(info.get("DescendantFonts"), [])
    child = doc.dict_of(below[0]) if isinstance(below, list) and below else {}
    descriptor = doc.dict_of(child.get("FontDescriptor", info.get("FontDescriptor")))
    _encode(doc, font, info, child, composite, cmap_folder, glyph_list)
    _measure(doc, font, info, child, descriptor, composite)
    _style(doc, font, info, descriptor)
    return font


def _encode(doc: Document, font: Font, info: dict, child: dict, composite: bool, folder: str | None, glyph_list) -> None:
    to_unicode, encoding = doc.get(info.get("ToUnicode")), doc.get(info.get("Encoding"))
    named = str(encoding) if isinstance(encoding, Name) else ""
    told = CMap()
    if isinstance(to_unicode, Stream):
        told = parse_cmap(doc.decoded(to_unicode), None, folder)
    elif isinstance(to_unicode, Name):
        told = predefined(str(to_unicode), folder)
    font.unicode = {k: v for k, v in told.chars.items() if usable(v)}
    if composite:
        codes = parse_cmap(doc.decoded(encoding), None, folder) if isinstance(encoding, Stream) else predefined(named or "Identity-H", folder)
        font.spaces = codes.spaces or told.spaces
        font.code_bytes = max([2, *(s[0] for s in font.spaces)])
        font.wmode = int(named.endswith("-V") or (isinstance(encoding, Stream) and encoding.info.get("WMode") == 1))
        if not font.unicode and not re.search("UTF16|UCS2", named):
            system = doc.dict_of(child.get("CIDSystemInfo"))
            registry, ordering = (doc.get(system.get(k), b"") for k in ("Registry", "Ordering"))
            if isinstance(ordering, bytes) and isinstance(registry, bytes):
                to = predefined(f"{registry.decode('latin-1')}-{ordering.decode('latin-1')}-UCS2", folder)
                font.unicode = {c: to.chars[cid] for c in range(65536) if (cid := codes.cids.get(c, c)) in to.chars} if to.chars else {}
        return
    font.spaces = told.spaces if any(s[0] == 1 for s in told.spaces) else []
    base = encoding_table(named) or symbolic_table(font.base_font)
    if isinstance(encoding, (dict, Stream)):
        info_e = doc.dict_of(encoding)
        base = encoding_table(str(info_e.get("BaseEncoding", ""))) or symbolic_table(font.base_font)
        code = 0
        for x in doc.get(info_e.get("Differences"), []):
            x = doc.get(x)
            if isinstance(x, int):
                code = x
            elif isinstance(x, Name):
                if cp := glyph_name_to_unicode(x, glyph_list):
                    base[code] = cp
                code += 1
    for code in range(256):
        if code not in font.unicode:
            font.unicode[code] = [base.get(code, code if not base or code < 128 else REPLACEMENT)]
    if info.get("Subtype") == "Type3":
        for code in range(32, 127):
            if font.unicode[code] == [REPLACEMENT]:
                font.unicode[code] = [code]


def cid_widths(doc: Document, items: list) -> dict[int, float]:
    """Widths of a list with entries ``first [w ...]`` and ``first last w``."""
    out, i = {}, 0
    items = [doc.get(x) for x in items]
    while i + 1 < len(items):
        first, then = items[i], items[i + 1]
        if isinstance(then, list):
            out.update({int(first) + k: (_number(doc, w, 0.0)) / 1000 for k, w in enumerate(then)})
            i += 2
        elif i + 2 < len(items) and isinstance(first, (int, float)) and isinstance(then, (int, float)):
            low, high = sorted((int(first), int(then)))
            out.update(dict.fromkeys(range(low, min(high, low + 65535) + 1), _number(doc, items[i + 2], 0.0) / 1000))
            i += 3
        else:
            i += 1
    return out


def vertical_widths(doc: Document, items: list) -> dict[int, tuple[float, float, float]]:
    """Vertical metrics (advance, origin x, origin y) of a list with entries ``first [w x y ...]`` and ``first last w x y``."""
    out, i = {}, 0
    items = [doc.get(x) for x in items]
    while i + 1 < len(items):
        if isinstance(items[i + 1], list):
            v = [_number(doc, x, 0.0) / 1000 for x in items[i + 1]]
            out.update({int(items[i]) + k // 3: tuple(v[k : k + 3]) for k in range(0, len(v) - 2, 3)})
            i += 2
        elif i + 4 < len(items):
            v = tuple(_number(doc, x, 0.0) / 1000 for x in items[i + 2 : i + 5])
            out.update(dict.fromkeys(range(int(items[i]), min(int(items[i + 1]), int(items[i]) + 65535) + 1), v))
            i += 5
        else:
            break
    return out


def _measure(doc: Document, font: Font, info: dict, child: dict, descriptor: dict, composite: bool) -> None:
    if composite:
        font.widths = cid_widths(doc, doc.get(child.get("W"), []))
        font.default_width = (_number(doc, child.get("DW"), 1000.0)) / 1000
        font.vertical = vertical_widths(doc, doc.get(child.get("W2"), []))
        return
    matrix = doc.get(info.get("FontMatrix"), [])
    scale = _number(doc, matrix[0], 0.001) if info.get("Subtype") == "Type3" and isinstance(matrix, list) and matrix else 0.001
    first = int(_number(doc, info.get("FirstChar"), 0))
    given = doc.get(info.get("Widths"), [])
    font.widths = {first + k: w * scale for k, x in enumerate(given) if (w := _number(doc, x)) is not None}
    missing = _number(doc, descriptor.get("MissingWidth"))
    if font.widths:
        font.default_width = missing * scale if missing is not None else None
    else:
        font.widths = {c: standard_width(font.base_font, c) for c in range(256)}


def standard_width(name: str, code: int) -> float:
    """Plain form of the column function of this name."""
    lower = name.lower()
    if "courier" in lower:
        return 0.6
    if "symbol" in lower or "zapfdingbats" in lower:
        return 0.5
    if "times" in lower:
        c = chr(code)
        groups = ((" ',.:;", 0.25), ("!I", 0.333), ("0123456789", 0.5), ("M", 0.889), ("W", 0.944), ("il", 0.278), ("m", 0.778), ("w", 0.722))
        for members, w in groups:
            if c in members:
                return w
        return 0.667 if "A" <= c <= "Z" else 0.444 if "a" <= c <= "z" else 0.5
    if not 0 <= code < 256:
        return 0.55
    return rules.SANS_WIDTHS[code - 32] / 1000 if 32 <= code < 128 else 0.278 if code < 32 else 0.0


def _style(doc: Document, font: Font, info: dict, descriptor: dict) -> None:
    lower, flags = font.base_font.lower(), int(_number(doc, descriptor.get("Flags"), 0))
    weight = _number(doc, descriptor.get("FontWeight"), 0.0)
    font.bold = bool(flags & 262144) or weight >= 700 or any(k in lower for k in rules.BOLD)
    font.italic = bool(flags & 64) or any(k in lower for k in rules.ITALIC)
    font.serif = not any(k in lower for k in rules.SANS)
    font.mono = bool(flags & 1) or any(k in lower for k in rules.MONO)
    up, down = next((up, down) for parts, up, down in rules.STANDARD_METRICS if not parts or any(p in lower for p in parts))
    if descriptor:
        up = _number(doc, descriptor.get("Ascent"), up * 1000) / 1000
        down = _number(doc, descriptor.get("Descent"), down * 1000) / 1000
    elif info.get("Subtype") == "Type3":
        box, m = ([_number(doc, x, 0.0) for x in doc.get(info.get(k), [])] for k in ("FontBBox", "FontMatrix"))
        if len(box) == 4:
            scale = m[3] if len(m) == 6 else 0.001
            up, down = max(box[1] * scale, box[3] * scale), min(box[1] * scale, box[3] * scale)
    font.ascent = min(0.8 if up <= 0.01 else up, 3.0)
    font.descent = max(-0.2 if down >= -0.01 else down, -3.0)
