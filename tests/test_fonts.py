import struct

from vellum.functions import icc
from vellum.sources import fontfiles, pdffont
from vellum.sources.document import Document
from vellum.sources.interpreter import Interpreter
from vellum.sources.syntax import Name, Stream
from vellum.operators import insert, output
from vellum.operators import layout
from vellum.sources import pdf

from .pdfmaker import HELVETICA, build, text
from .test_pdf import drawn, frame, shown


def font_file(family="Testing Sans", codes="AB é", bold=False):
    """A file with the tables that the parser reads."""
    cps = sorted(map(ord, codes))
    name = family.encode("utf-16-be")
    ends = [*cps, 0xFFFF]
    n = len(ends)
    deltas = [(i + 1 - cp) % 65536 for i, cp in enumerate(cps)] + [1]
    cmap4 = struct.pack(">HHHHHHH", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + struct.pack(f">{n}H", *ends) + b"\0\0" + struct.pack(f">{n}H", *ends) + struct.pack(f">{n}H", *deltas) + struct.pack(f">{n}H", *[0] * n)
    tables = {
        b"cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + cmap4,
        b"head": b"\0" * 18 + struct.pack(">H", 2000) + b"\0" * 24 + struct.pack(">H", int(bold)) + b"\0" * 8,
        b"hhea": b"\0" * 4 + struct.pack(">hh", 1800, -400) + b"\0" * 26 + struct.pack(">H", len(cps) + 1),
        b"hmtx": b"".join(struct.pack(">Hh", 500 + 100 * i, 0) for i in range(len(cps) + 1)),
        b"name": struct.pack(">HHH6H", 0, 1, 18, 3, 1, 0x409, 1, len(name), 0) + name,
    }
    out, body, at = b"\0\1\0\0" + struct.pack(">HHHH", len(tables), 0, 0, 0), b"", 12 + 16 * len(tables)
    for tag, data in tables.items():
        out += tag + struct.pack(">III", 0, at + len(body), len(data))
        body += data
    return out + body


def test_parse_font_file():
    face = fontfiles.parse(font_file(bold=True))
    assert face.family == "Testing Sans" and face.bold and not face.italic and face.units == 2000 and face.ascent == 0.9
    assert face.glyphs == {32: 1, 65: 2, 66: 3, 233: 4} and face.advance(65) == 0.35 and face.advance(0x4E00) == 0.5


def test_scan_and_choice(spark, tmp_path):
    (tmp_path / "a.ttf").write_bytes(font_file("Arial", "ABC"))
    (tmp_path / "b.otf").write_bytes(font_file("Other", "XYZ", True))
    faces = fontfiles.scan(spark, str(tmp_path))
    assert {(r.family, r.bold, r.fallback) for r in faces.collect()} == {("Arial", False, True), ("Other", True, False)}
    tasks = spark.createDataFrame([(1, "ABC", "", False, False), (2, "XY", "arial", False, False)], "task_id long, text string, family string, bold boolean, italic boolean")
    grid = fontfiles.grid(tasks, faces)
    best = insert.choose_font(tasks.selectExpr("task_id", "family", "bold", "italic", "length(text) as n_chars"), grid).orderBy("task_id").collect()
    assert [(r.slot_family, r.tier) for r in best] == [("arial", 3), ("other", 5)]


def test_embedded_font_is_read_back():
    data = font_file()
    face = fontfiles.parse(data)

    def extra(m):
        objects, ref = fontfiles.embedded(face, data, "AéB", len(m.objects) + 1)
        for n in sorted(objects):
            assert m.add(objects[n]).number == n
        return {"Font": {"F1": ref}}

    codes = "".join(f"{face.glyphs[ord(c)]:04X}" for c in "BéA")
    out = drawn(build([f"BT /F1 10 Tf 0 0 Td <{codes}> Tj ET".encode()], extra=extra))
    assert "".join(g[1] for g in out.glyphs) == "BéA" and [g[5] for g in out.glyphs] == [0.4, 0.45, 0.35] and out.glyphs[0][9] == 0.9
    many = fontfiles.to_unicode({i: chr(0x4E00 + i) for i in range(250)})
    assert many.count(b"beginbfchar") == 3 and pdffont.parse_cmap(many).chars[249] == [0x4E00 + 249]


def profile():
    tags = {b"rXYZ": (0.4361, 0.2225, 0.0139), b"gXYZ": (0.3851, 0.7169, 0.0971), b"bXYZ": (0.1431, 0.0606, 0.7139)}
    body, table, at = b"", b"", 132 + 12 * 6
    items = {k: b"XYZ \0\0\0\0" + b"".join(struct.pack(">i", round(v * 65536)) for v in xyz) for k, xyz in tags.items()}
    items |= {b"rTRC": b"curv\0\0\0\0" + struct.pack(">IH", 1, round(2.2 * 256)), b"gTRC": b"curv\0\0\0\0" + struct.pack(">I", 0), b"bTRC": b"curv\0\0\0\0" + struct.pack(">I3H", 3, 0, 32768, 65535)}
    for tag, data in items.items():
        table += tag + struct.pack(">II", at + len(body), len(data))
        body += data
    return b"\0" * 128 + struct.pack(">I", 6) + table + body


def test_icc_profiles():
    p = icc.parse(profile())
    assert all(abs(v - 1) < 0.02 for v in p.rgb([1, 1, 1])) and all(abs(v) < 0.01 for v in p.rgb([0, 0, 0]))
    assert p.curves[0](0.5) < 0.25 and p.curves[1](0.5) == 0.5 and abs(p.curves[2](0.25) - 0.25) < 0.01
    assert icc.parse(b"nothing") is None
    space = lambda m: {"ColorSpace": {"CS": [Name("ICCBased"), m.add(Stream({"N": 3}, profile()))]}}
    white, black = (g[12] for g in drawn(build([b"BT /CS cs /F1 9 Tf 1 1 1 scn (a) Tj 0 0 0 scn (b) Tj ET"], extra=space)).glyphs)
    assert white >= 0xF5F5F5 and black == 0


def test_symbol_fonts():
    symbol = {**{k: v for k, v in HELVETICA.items() if k != "Encoding"}, "BaseFont": Name("Symbol")}
    assert shown(build([b"BT /F1 9 Tf (abW) Tj ET"], {"F1": symbol})) == "αβΩ"
    assert shown(build([b"BT /F1 9 Tf (Hl) Tj ET"], {"F1": {**symbol, "BaseFont": Name("ZapfDingbats")}})) == "★●"


def test_images_among_blocks(spark):
    def extra(m):
        return {"XObject": {"Im": m.add(Stream({"Subtype": Name("Image"), "Width": 1, "Height": 1, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}, b"\x7f"))}}

    docs = frame(spark, build([text("one") + b" q 10 0 0 10 50 600 cm /Im Do Q " + text("two", y=400)], extra=extra))
    chars = layout.glyph_boxes(layout.laid_out(pdf.glyphs(docs)))
    rows = output.blocks_with_images(chars, pdf.images(docs)).orderBy("block_no").collect()
    assert [(r.type, r.text) for r in rows] == [(0, "one\n"), (1, ""), (0, "two\n")]


def test_pages_of_one_document_over_tasks(spark):
    docs = frame(spark, build([text(f"page {i}") for i in range(7)]))
    whole = sorted(map(tuple, pdf.glyphs(docs).collect()))
    assert sorted(map(tuple, pdf.glyphs(docs, split=3).collect())) == whole
    assert len({p.number for p in Document(bytes(docs.first().content)).pages()}) == 7 and Interpreter


def test_standard_widths_agree(spark):
    from pyspark.sql import functions as F

    from vellum.functions import fonts

    names = ["Helvetica", "Times-Roman", "Courier", "Symbol", "ABCDEF+Times"]
    rows = spark.createDataFrame([(n, c) for n in names for c in (0, 32, 65, 109, 127, 200, 300)], "n string, c int")
    for r in rows.withColumn("w", fonts.standard_width(F.col("n"), F.col("c"))).collect():
        assert r.w == pdffont.standard_width(r.n.split("+")[-1], r.c) or r.c == 300
