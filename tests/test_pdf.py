import random
import zlib

import pytest

from vellum.operators import layout, output
from vellum.sources import codec, pdf
from vellum.sources.document import Document
from vellum.sources.interpreter import Interpreter
from vellum.sources.pdffont import cid_widths, glyph_name_to_unicode, parse_cmap
from vellum.sources.syntax import Lexer, Name, Ref, Stream, operations, write

from .pdfmaker import HELVETICA, Maker, build, text


def frame(spark, *docs):
    return spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(docs)], "doc_id long, content binary")


def chars(spark, *docs):
    return layout.glyph_boxes(layout.laid_out(pdf.glyphs(frame(spark, *docs))))


def texts(spark, *docs):
    return [r.text for r in output.document_text(output.page_text(chars(spark, *docs))).orderBy("doc_id").collect()]


def drawn(doc, page=0):
    d = Document(doc)
    return Interpreter(d, d.pages()[page]).run()


def shown(doc, page=0):
    return "".join(g[1] for g in drawn(doc, page).glyphs)


def test_text_of_all_file_forms(spark):
    pages = [text("Hello World", "second line"), text("page two")]
    want = "Hello World\nsecond line\n\fpage two\n"
    damaged = build(pages).replace(b"startxref", b"startxxxx")
    unreadable = b"not a document"
    docs = [build(pages), build(pages, flate=True), build(pages, how="packed"), damaged, unreadable]
    assert texts(spark, *docs) == [want] * 4
    assert [r.doc_id for r in pdf.errors(frame(spark, *docs)).collect()] == [4]
    found = {(r.doc_id, r.page_num): r for r in pdf.pages(frame(spark, *docs)).collect()}
    assert found[0, 1].width == 600 and found[0, 1].height == 800 and found[3, 0].repaired and not found[0, 0].is_encrypted


def test_left_out_content_is_reported(spark):
    many = build([text("a"), text("b")])
    assert pdf.errors(frame(spark, many)).count() == 0
    told = pdf.errors(frame(spark, many), max_runs=0).orderBy("error").collect()
    assert [(r.doc_id, r.error) for r in told] == [(0, f"page {n}: content streams after the first 0 left out") for n in (0, 1)]
    assert pdf.glyphs(frame(spark, many), max_runs=0).count() == 0 and pdf.glyphs(frame(spark, many)).count() == 2


def test_fallback_pages_without_a_tree():
    m = Maker()
    m.add(Stream({}, text("lost")))
    m.add(Stream({}, b"no text here"))
    doc = Document(m.classic(Ref(9)))
    assert [(p.obj_id, p.is_fallback) for p in doc.pages()] == [(1, True)]


def test_encryption_is_told():
    assert Document(build([b""], Encrypt={"Filter": Name("Standard")})).is_encrypted


def test_gaps_become_blanks_lines_and_blocks(spark):
    line = b"BT /F1 10 Tf 50 700 Td [(ab) -200 (cd) -400 (ef) -1000 (gh) 50 (ij)] TJ 0 -12 Td (next) Tj 0 -40 Td (block) Tj ET"
    rows = output.blocks(chars(spark, build([line]))).orderBy("block_no").collect()
    assert [r.text for r in rows] == ["ab cd ef\nghij\nnext\n", "block\n"]


def test_hyphens_at_line_ends(spark):
    doc = build([text("some-", "thing", "end-")])
    c = chars(spark, doc)
    assert output.page_text(c).first().text == "something\nend"
    assert output.page_text(chars(spark, build([b"BT /F1 10 Tf 12 TL 50 700 Td (a\xad) Tj T* (b) Tj ET"])), any_hyphen=True).first().text == "ab\n"


def test_modes(spark):
    doc = build([text("low", y=100) + text("high", y=700)])
    c = chars(spark, doc)
    assert output.text_in(c, "TEXT", sort=True).first().text == "high\nlow\n"
    assert output.text_in(c, "text").first().text == "low\nhigh\n"
    [page] = output.text_in(c, "rawdict", sort=True).collect()
    assert [b.lines[0].spans[0].text for b in page.blocks] == ["high", "low"] and page.blocks[0].lines[0].spans[0].chars[0].c == "h"
    assert '"text":"high"' in output.text_in(c, "json").first().json
    assert output.document_json(output.page_dict(c)).first().json.startswith("[{")
    with pytest.raises(ValueError):
        output.text_in(c, "xml")


def test_spans_follow_style(spark):
    fonts = {"F1": HELVETICA, "F2": {**HELVETICA, "BaseFont": Name("ABCDEF+Helvetica-Bold")}}
    doc = build([b"BT /F1 10 Tf 50 700 Td (plain ) Tj /F2 10 Tf (bold) Tj 1 0 0 rg (red) Tj ET"], fonts)
    rows = output.spans(layout.with_spans(chars(spark, doc))).orderBy("span_no").collect()
    assert [(r.text, r.bold, r.color, r.flags) for r in rows] == [("plain ", False, 0, 0), ("bold", True, 0, 16), ("red", True, 0xFF0000, 16)]
    assert output.font_names(pdf.glyphs(frame(spark, doc))).first().fonts == ["Helvetica", "Helvetica-Bold"]


def test_to_unicode_and_codespaces():
    cmap = b"1 begincodespacerange <00> <7F> endcodespacerange 1 begincodespacerange <8000> <FFFF> endcodespacerange 2 beginbfchar <41> <0061> <8001> <00660069> endbfchar 1 beginbfrange <50> <52> <0078> endbfrange 1 beginbfrange <60> <61> [<0031> <0032>] endbfrange 1 beginbfrange <8100> <8101> <00410042> endbfrange"
    m = parse_cmap(cmap)
    assert m.spaces == [(2, 0x8000, 0xFFFF), (1, 0, 0x7F)] and m.chars[0x52] == [0x7A] and m.chars[0x61] == [0x32] and m.chars[0x8101] == [0x41, 0x43]

    def fonts(maker):
        to = maker.add(Stream({}, cmap))
        child = maker.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("X"), "DW": 500, "W": [1, [600, 700], 5, 9, 250]})
        return {"Font": {"F1": maker.add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("X"), "Encoding": Name("Identity-H"), "ToUnicode": to, "DescendantFonts": [child]})}}

    out = drawn(build([b"BT /F1 10 Tf 0 0 Td <80010041> Tj ET"], extra=fonts))
    assert [(g[1], round(g[5], 3)) for g in out.glyphs] == [("f", 0.5), ("i", 0.0), ("a", 0.5)]
    assert parse_cmap(bytes(range(64)) * 2).chars == {}


def test_encodings_and_names():
    font = {**HELVETICA, "Encoding": {"BaseEncoding": Name("WinAnsiEncoding"), "Differences": [65, Name("eacute"), Name("fi"), Name("uni20AC"), Name("Alpha")]}}
    assert shown(build([b"BT /F1 10 Tf (ABCD\x80) Tj ET"], {"F1": font})) == "éfi€Α€"
    names = {"space": 32, "A.alt": 65, "f_f_i": 0xFB03, "uni0041": 65, "u1F600": 0x1F600, "a45": 45, "g7": 7, "12": 12, "Ccaron": 0x10C, "omega": 0x3C9, "zzz": 0, "a_b": 97}
    assert {n: glyph_name_to_unicode(n) for n in names} == names


def test_widths():
    doc = Document(build([b""]))
    assert cid_widths(doc, [1, [500, 600], 10, 8, 250, 20]) == {1: 0.5, 2: 0.6, 8: 0.25, 9: 0.25, 10: 0.25}
    font = {**HELVETICA, "FirstChar": 65, "Widths": [1000, 250], "FontDescriptor": {"MissingWidth": 400, "Ascent": 900, "Descent": -300, "Flags": 65}}
    got = drawn(build([b"BT /F1 10 Tf (ABC) Tj ET"], {"F1": font})).glyphs
    assert [g[5] for g in got] == [1.0, 0.25, 0.4] and got[0][9:11] == (0.9, -0.3) and got[0][14] and got[0][16]
    assert [g[3] for g in got] == [0.0, 10.0, 12.5]


def test_text_state():
    got = drawn(build([b"BT /F1 10 Tf 2 Tc 3 Tw 50 Tz 4 Ts 10 20 Td (a b) Tj ET"])).glyphs
    a, blank, b = ((g[3], g[4]) for g in got)
    assert a == (10.0, 800 - 24.0) and blank[0] == pytest.approx(10 + (5.56 + 2) * 0.5) and b[0] == pytest.approx(blank[0] + (2.78 + 5) * 0.5)
    quotes = shown(build([b'BT /F1 10 Tf 12 TL (a) Tj (b) \' 1 2 (c) " T* (d) Tj ET']))
    assert quotes == "abcd"


def test_colours():
    shades = b"BT /F1 9 Tf 0.5 g (a) Tj 0 1 0 rg (b) Tj 0 0 0 1 k (c) Tj 1 Tr 1 0 0 RG (d) Tj 3 Tr (e) Tj /CS1 cs 1 scn (f) Tj ET"
    tint = {"CS1": [Name("Separation"), Name("Spot"), Name("DeviceRGB"), {"FunctionType": 2, "C0": [1, 1, 1], "C1": [0, 0, 1], "N": 1}]}
    assert [g[12] for g in drawn(build([shades], resources={"ColorSpace": tint})).glyphs] == [0x808080, 0x00FF00, 0x231F20, 0xFF0000, 0x231F20, 0x0000FF]


def test_rotation_and_crop():
    box = {"MediaBox": [0, 0, 200, 100], "CropBox": [10, 20, 300, 90]}
    for rotate, place, size, direction in ((0, (40, 40), (190, 70), (1, 0)), (90, (30, 40), (70, 190), (0, 1)), (180, (150, 30), (190, 70), (-1, 0)), (270, (40, 150), (70, 190), (0, -1)), (-90, (40, 150), (70, 190), (0, -1)), (450, (30, 40), (70, 190), (0, 1))):
        doc = Document(build([b"BT /F1 10 Tf 50 50 Td (x) Tj ET"], page={**box, "Rotate": rotate}))
        page = doc.pages()[0]
        g = Interpreter(doc, page).run().glyphs[0]
        assert (g[3], g[4]) == pytest.approx(place) and (page.rect.width, page.rect.height) == size and (g[6], g[7]) == pytest.approx(direction)


def test_forms_images_and_clip():
    def extra(m):
        image = m.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 2, "Height": 1, "BitsPerComponent": 8, "ColorSpace": [Name("Indexed"), Name("DeviceRGB"), 1, b"\x00\x00\x00\xff\xff\xff"]}, b"\x00\x01"))
        inner = m.add(Stream({"Subtype": Name("Form"), "Resources": {"XObject": {"Im": image}}}, b"BT /F1 10 Tf (in) Tj ET q 20 0 0 10 5 5 cm /Im Do Q"))
        outer = m.add(Stream({"Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, 100, 0], "Resources": {"XObject": {"Fm": inner}}}, b"/Fm Do"))
        return {"XObject": {"Fm": outer, "Im": image}}

    out = drawn(build([b"/Fm Do /Fm Do q 10 0 0 10 0 0 cm /Im Do Q"], extra=extra))
    assert "".join(g[1] for g in out.glyphs) == "inin" and out.glyphs[0][3] == 100 and out.glyphs[2][21]
    assert [(i[1], i[3:7], i[15]) for i in out.images][:1] == [("form_child", (105, 785, 125, 795), b"\x00\x00\x00\xff\xff\xff")] and out.images[2][1] == "Im"
    clip = b"q 0 0 100 100 re W n BT /F1 10 Tf 10 10 Td (in) Tj 500 0 Td (out) Tj ET Q BT /F1 10 Tf 500 10 Td (free) Tj ET"
    assert shown(build([clip])) == "infree"


def test_drawings():
    out = drawn(build([b"1 0 0 RG 0 0 1 rg 2 w 10 10 50 20 re B 0 0 m 5 5 l S 0 0 m 1 1 2 2 3 3 c f* 1 1 m n"])).drawings
    assert [(d[1], d[3], d[4], d[6]) for d in out] == [("fs", 0xFF0000, 0x0000FF, False), ("s", 0xFF0000, None, False), ("f", None, 0x0000FF, True)]
    assert out[0][2][0] == {"cmd": "m", "points": [{"x": 10, "y": 790}]} and out[0][5] == 2


def test_actual_text():
    one = lambda body: shown(build([b"BT /F1 10 Tf " + body + b" ET"]))
    assert one(b"/Span <</ActualText (Hello)>> BDC (Hxllo) Tj EMC (!) Tj") == "Hello!"
    assert one(b"/Span <</ActualText <FEFF00660066>>> BDC (\x01) Tj EMC") == "ff"
    assert one(b"/Span <</ActualText (abcdef)>> BDC (abc) Tj (def) Tj EMC") == "abcdef"
    assert one(b"/Span BMC (plain) Tj EMC") == "plain"


def test_invisible_text_and_inline_images():
    assert shown(build([b"BI /W 1 /H 1 ID \x00\x01 (no) EI BT 3 Tr /F1 10 Tf (yes) Tj ET (outside) Tj"])) == "yes"


def test_right_to_left(spark):
    from vellum.operators import bidi

    cmap = Stream({}, b"1 beginbfrange <41> <5A> <05D0> endbfrange")
    fonts = lambda m: {"Font": {"F1": m.add({**HELVETICA, "ToUnicode": m.add(cmap), "Widths": [500] * 26, "FirstChar": 65})}}
    doc = build([b"BT /F1 10 Tf 100 700 Td (CBA) Tj ET"], extra=fonts)
    c = bidi.reordered(chars(spark, doc))
    assert output.page_text(c).first().text == "אבג\n"


def test_codecs_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 100, 5000):
        data = bytes(rng.choice(b"\0\0\0abc" + bytes([rng.randrange(256)])) for _ in range(n))
        assert codec.flate(zlib.compress(data)) == data or not n
        assert codec.ascii_hex(data.hex().encode() + b">") == data
        import base64

        assert codec.ascii85(base64.a85encode(data, adobe=True)) == data
        assert codec.lzw(lzw_encode(data)) == data
        packed = b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, n, 128)) + b"\x80"
        assert codec.run_length(packed) == data
    assert codec.run_length(b"\xfea\x80") == b"aaa" and codec.ascii85(b"!") == b"" and codec.ascii_hex(b"4 1 5>") == b"AP"
    assert codec.decode(b"x", ["Nothing"], []) == (b"", None) and codec.decode(b"x", ["DCTDecode"], []) == (b"x", "DCTDecode")
    raw = bytes(range(30))
    for kind in range(5):
        assert codec.unpredict(png(raw, 6, kind, 3), 15, 3, 8, 2) == raw
    assert codec.unpredict(bytes([1, 1, 1, 5, 5, 5]), 2, 1, 8, 3) == bytes([1, 2, 3, 5, 10, 15])


def lzw_encode(data):
    table, width, out, bits, held = {bytes([i]): i for i in range(256)}, 9, bytearray(), 0, 0
    codes, w, size = [256], b"", 258
    widths = [9]
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        codes.append(table[w])
        widths.append(width)
        table[w + bytes([b])] = size
        size += 1
        width = 9 + sum(size >= n for n in (512, 1024, 2048))
        w = bytes([b])
        if size == 4095:
            codes.append(256)
            widths.append(width)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
    codes += [table[w], 257] if w else [257]
    widths += [width, 9 + sum(size + bool(w) >= n for n in (512, 1024, 2048))] if w else [width]
    for code, n in zip(codes, widths, strict=True):
        bits, held = bits << n | code, held + n
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
            bits &= (1 << held) - 1
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


def png(raw, row, kind, step):
    out, above = b"", bytes(row)
    for at in range(0, len(raw), row):
        line = raw[at : at + row]
        guess = []
        for i in range(row):
            a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            guess.append((0, a, b, (a + b) // 2, paeth)[kind])
        out += bytes([kind]) + bytes(x - g & 255 for x, g in zip(line, guess, strict=True))
        above = line
    return out


def test_syntax_round_trip():
    value = {"A": [1, -2.5, Name("x y"), b"(\\)\x00", None, True, Ref(3, 0)], "B": {"C": []}}
    assert Lexer(write(value)).next() == value
    assert Lexer(rb"(a\(b\)\n\101\
c(nested))").next() == b"a(b)\nAc(nested)"
    assert list(operations(b"1 0 0 rg % note\n(a) Tj [1 (b)] TJ")) == [("rg", [1, 0, 0]), ("Tj", [b"a"]), ("TJ", [[1, b"b"]])]


def test_source_reads_only_wanted_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(build([text("one"), text("two")]))
    pdf.register(spark)
    rows = spark.read.format("vellum_pdf").load(str(tmp_path)).where("page_num = 1").orderBy("seq").collect()
    assert "".join(r.c for r in rows) == "two"
    files = pdf.read_files(spark, str(tmp_path / "*.pdf"))
    assert pdf.glyphs(files, pages=(0,)).count() == 3
    assert {r.type for r in pdf.objects(files).collect()} >= {"Catalog", "Pages", "Page", "Font"}
    assert {r.base_font for r in pdf.fonts(files).collect()} == {"Helvetica"}
