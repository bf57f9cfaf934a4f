"""Font files: which faces a folder has, what they cover, and their embedding in documents."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .syntax import Name, Ref, Stream

# Families that serve as safe fallback faces.
FALLBACKS = ("arial", "noto", "dejavu", "liberation", "roboto", "times", "segoe")
#: Entries of one block of a ToUnicode map.
CHUNK = 100


@dataclass
class Face:
    family: str = ""
    bold: bool = False
    italic: bool = False
    units: int = 1000
    ascent: float = 0.8
    descent: float = -0.2
    glyphs: dict[int, int] = field(default_factory=dict)  # code point to glyph
    widths: list[int] = field(default_factory=list)
    is_cff: bool = False

    def advance(self, cp: int) -> float:
        """Advance in ems; half an em where the face has no glyph."""
        g = self.glyphs.get(cp)
        return self.widths[min(g, len(self.widths) - 1)] / self.units if g is not None and self.widths else 0.5


def parse(data: bytes) -> Face:
    """Names, style, metrics, coverage and widths of a TrueType or OpenType file."""
    kind = data[:4]
    if kind == b"ttcf":  # a collection: its first face
        return _face(data, struct.unpack_from(">I", data, 12)[0])
    return _face(data, 0)


def _face(data: bytes, start: int) -> Face:
    n = struct.unpack_from(">H", data, start + 4)[0]
    tables = {tag: data[at : at + size] for tag, _, at, size in (struct.unpack_from(">4sIII", data, start + 12 + 16 * i) for i in range(n))}
    face = Face(is_cff=b"CFF " in tables)
    head, hhea = tables.get(b"head", b""), tables.get(b"hhea", b"")
    if len(head) >= 46:
        face.units = struct.unpack_from(">H", head, 18)[0] or 1000
        style = struct.unpack_from(">H", head, 44)[0]
        face.bold, face.italic = bool(style & 1), bool(style & 2)
    if len(hhea) >= 36:
        up, down = struct.unpack_from(">hh", hhea, 4)
        face.ascent, face.descent = up / face.units, down / face.units
        count, hmtx = struct.unpack_from(">H", hhea, 34)[0], tables.get(b"hmtx", b"")
        face.widths = [struct.unpack_from(">H", hmtx, 4 * i)[0] for i in range(min(count, len(hmtx) // 4))]
    face.family = _family(tables.get(b"name", b""))
    if re.search("bold|black|heavy", face.family.lower()):
        face.bold = True
    face.glyphs = _coverage(tables.get(b"cmap", b""))
    return face


def _family(name: bytes) -> str:
    if len(name) < 6:
        return ""
    _, n, base = struct.unpack_from(">HHH", name)
    for platform, _, _, kind, size, at in (struct.unpack_from(">6H", name, 6 + 12 * i) for i in range(n)):
        if kind == 1:
            raw = name[base + at : base + at + size]
            return raw.decode("utf-16-be" if platform in (0, 3) else "latin-1", "replace")
    return ""


def _coverage(cmap: bytes) -> dict[int, int]:
    out: dict[int, int] = {}
    if len(cmap) < 4:
        return out
    for i in range(struct.unpack_from(">H", cmap, 2)[0]):
        platform, _, at = struct.unpack_from(">HHI", cmap, 4 + 8 * i)
        form = struct.unpack_from(">H", cmap, at)[0]
        if platform not in (0, 3):
            continue
        if form == 4:
            n = struct.unpack_from(">H", cmap, at + 6)[0] // 2
            ends, starts = struct.unpack_from(f">{n}H", cmap, at + 14), struct.unpack_from(f">{n}H", cmap, at + 16 + 2 * n)
            deltas, offsets = struct.unpack_from(f">{n}H", cmap, at + 16 + 4 * n), struct.unpack_from(f">{n}H", cmap, at + 16 + 6 * n)
            for k in range(n):
                for cp in range(starts[k], min(ends[k], 0xFFFE) + 1):
                    g = cp
                    if offsets[k]:
                        place = at + 16 + 6 * n + 2 * k + offsets[k] + 2 * (cp - starts[k])
                        g = struct.unpack_from(">H", cmap, place)[0] if place + 2 <= len(cmap) else 0
                        if not g:
                            continue
                    if glyph := g + deltas[k] & 0xFFFF:
                        out.setdefault(cp, glyph)
        elif form == 12:
            for k in range(struct.unpack_from(">I", cmap, at + 12)[0]):
                low, high, first = struct.unpack_from(">3I", cmap, at + 16 + 12 * k)
                for cp in range(low, min(high, low + 0xFFFF) + 1):
                    out.setdefault(cp, first + cp - low)
    return out


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Faces of a folder: (path, family, bold, italic, fallback, ascent, codepoints)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{ttf,otf,TTF,OTF}").option("recursiveFileLookup", "true").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            faces = []
            for content in batch.column(1).to_pylist():
                try:
                    faces.append(parse(content))
                except (struct.error, IndexError):
                    faces.append(Face())
            columns = [[f.family for f in faces], [f.bold for f in faces], [f.italic for f in faces], [any(k in f.family.lower() for k in FALLBACKS) for f in faces], [f.ascent for f in faces], [sorted(f.glyphs) for f in faces]]
            types = [pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.float64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["path", "family", "bold", "italic", "fallback", "ascent", "codepoints"])

    return files.select("path", "content").mapInArrow(run, "path string, family string, bold boolean, italic boolean, fallback boolean, ascent double, codepoints array<int>")


def grid(tasks: DataFrame, faces: DataFrame) -> DataFrame:
    """Coverage of each task's characters by each face, as ``insert.choose_font`` wants it.

    The faces are a stated set, those of one folder, and each task is scored against all of them.
    """
    from ..functions import fonts, text
    from ..operators.sizes import small

    slots = faces.select(F.xxhash64("path").alias("slot_id"), fonts.family(F.col("family")).alias("slot_family"), F.col("bold").alias("slot_bold"), F.col("italic").alias("slot_italic"), "fallback", "codepoints")
    used = tasks.select("task_id", text.codepoints(F.col("text")).alias("_cps"))
    both = used.crossJoin(small(slots, 10_000))
    return both.withColumn("covered", F.size(F.filter("_cps", lambda c: F.array_contains("codepoints", c.cast("int"))))).drop("_cps", "codepoints")


def to_unicode(glyphs: dict[int, str]) -> bytes:
    """A CMap from two-byte codes to text, in blocks."""
    rows = [f"<{g:04X}> <{t.encode('utf-16-be').hex().upper()}>" for g, t in sorted(glyphs.items())]
    blocks = "\n".join(f"{len(part)} beginbfchar\n" + "\n".join(part) + "\nendbfchar" for part in (rows[i : i + CHUNK] for i in range(0, len(rows), CHUNK)))
    return f"/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapName /V def\n/CMapType 2 def\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n{blocks}\nendcmap\nend\nend\n".encode()


def embedded(face: Face, data: bytes, text: str, first: int) -> tuple[dict[int, object], Ref]:
    """Objects from number ``first`` on that embed a face for a text, and the font's reference.  Codes are glyph numbers."""
    used = {face.glyphs[ord(c)]: c for c in text if ord(c) in face.glyphs}
    name = Name(re.sub("[^A-Za-z0-9]", "", face.family) or "Embedded")
    widths = [x for g in sorted(used) for x in (g, [round(face.advance(ord(used[g])) * 1000)])]
    file, descriptor, child, cmap, font = (Ref(first + i) for i in range(5))
    info = {"Filter": Name("FlateDecode"), **({"Subtype": Name("OpenType")} if face.is_cff else {"Length1": len(data)})}
    flags = 32 | 64 * face.italic | 262144 * face.bold
    objects = {
        file.number: Stream(info, zlib.compress(data)),
        descriptor.number: {"Type": Name("FontDescriptor"), "FontName": name, "Flags": flags, "Ascent": round(face.ascent * 1000), "Descent": round(face.descent * 1000), "ItalicAngle": 0, "CapHeight": 700, "StemV": 80, "FontBBox": [0, -300, 1000, 1000], "FontFile3" if face.is_cff else "FontFile2": file},
        child.number: {"Type": Name("Font"), "Subtype": Name("CIDFontType0" if face.is_cff else "CIDFontType2"), "BaseFont": name, "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}, "FontDescriptor": descriptor, "DW": 500, "W": widths, **({} if face.is_cff else {"CIDToGIDMap": Name("Identity")})},
        cmap.number: Stream({}, to_unicode(used)),
        font.number: {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": name, "Encoding": Name("Identity-H"), "DescendantFonts": [child], "ToUnicode": cmap},
    }
    return objects, font
