import json
import struct
import zlib

from vellum.functions import pixels
from vellum.functions.geometry import Rect
from vellum.plans import documents as files
from vellum.sources import pdffont, writer
from vellum.sources.document import Document
from vellum.sources.interpreter import Run
from vellum.sources.pdffont import Font
from vellum.sources.syntax import Name, Stream

from .pdfmaker import build, text
from .test_pdf import drawn, frame, shown


def places(doc, page=0):
    return [(g[1], round(g[3], 2), round(g[4], 2)) for g in drawn(doc, page).glyphs]


def test_redaction_removes_text_and_keeps_places():
    for how in ("classic", "packed"):
        doc = build([text("Hello World", "second"), text("other")], how=how)
        new = writer.redact(doc, {0: [Rect(50, 90, 73, 103)]})
        assert new.startswith(doc) and shown(new) == " Worldsecond"
        kept = [p for p in places(doc) if p in places(new)]
        assert kept == places(new) and shown(new, 1) == "other"
        twice = writer.redact(new, {1: [Rect(0, 0, 600, 800)]})
        assert shown(twice, 1) == "" and shown(twice) == shown(new)
    assert writer.redact(doc, {0: [Rect(0, 0, 5, 5)]}) == doc


def test_redaction_of_every_way_to_show_text():
    body = b'BT /F1 10 Tf 12 TL 50 700 Td (ab) Tj [(cd) -100 (ef)] TJ (gh) \' 1 2 (ij) " ET BI /W 1 ID x EI BT /F1 10 Tf 50 600 Td (end) Tj ET'
    doc = build([body])
    new = writer.redact(doc, {0: [Rect(50, 100, 54, 100)]})
    assert shown(new) == "bcdefghijend" and set(places(new)) <= set(places(doc)) and b"BI /W 1 ID x EI" in new
    assert shown(writer.redact(doc, {0: [Rect(0, 0, 600, 150)]})) == "end"
    told = build([b"BT /F1 10 Tf 50 700 Td /Span <</ActualText (secret)>> BDC (secret) Tj EMC ET"])
    assert b"secret" not in writer.redact(told, {0: [Rect(0, 0, 600, 800)]})[len(told) :] and shown(writer.redact(told, {0: [Rect(0, 0, 600, 800)]})) == ""


def test_least_overlap():
    doc = build([text("wide")])
    edge = {0: [Rect(0, 0, 52, 800)]}
    assert shown(writer.redact(doc, edge)) == "ide" and shown(writer.redact(doc, edge, min_overlap=0.9)) == "wide"


def test_forms_lose_what_any_of_their_places_loses():
    def extra(m):
        return {"XObject": {"Fm": m.add(Stream({"Subtype": Name("Form")}, b"BT /F1 10 Tf (form) Tj ET"))}}

    doc = build([b"/Fm Do q 1 0 0 1 200 200 cm /Fm Do Q", b"/Fm Do"], extra=extra)
    new = writer.redact(doc, {0: [Rect(200, 590, 203, 602)]})
    assert shown(new) == "ormorm" and shown(new, 1) == "orm"


def test_repaired_documents_can_be_redacted():
    damaged = build([text("Hello")]).replace(b"startxref", b"startxxxx")
    assert shown(writer.redact(damaged, {0: [Rect(0, 0, 600, 800)]})) == ""


def test_over_dataframes(spark):
    docs = frame(spark, build([text("one")]), build([text("two")]))
    zones = spark.createDataFrame([(0, 0, 0.0, 0.0, 600.0, 800.0)], "doc_id long, page_num int, x0 double, y0 double, x1 double, y1 double")
    assert [shown(bytes(r.content)) for r in writer.redact_documents(docs, zones).orderBy("doc_id").collect()] == ["", "two"]
    tasks = spark.createDataFrame([(1, 0, 2, "later", 10.0, 10.0, 200.0, 30.0, True), (1, 0, 1, "first", 10.0, 40.0, 200.0, 60.0, False)], "doc_id long, page_num int, seq int, text string, x0 double, y0 double, x1 double, y1 double, bold boolean")
    [a, b] = [bytes(r.content) for r in writer.insert_text(docs, tasks).orderBy("doc_id").collect()]
    assert shown(a) == "one" and shown(b) == "twofirstlater"
    assert [g[11] for g in drawn(b).glyphs][-1] == "Helvetica-Bold"
    rects = spark.createDataFrame([(0, 0, 10.0, 10.0, 20.0, 30.0, 255)], "doc_id long, page_num int, x0 double, y0 double, x1 double, y1 double, r int")
    [c, _] = [bytes(r.content) for r in writer.insert_rects(docs, rects).orderBy("doc_id").collect()]
    [d] = drawn(c).drawings
    assert d[1] == "f" and d[4] == 0xFF0000 and d[2][0]["points"][0] == {"x": 8.0, "y": 32.0}


def test_text_fits_its_box():
    page = Document(build([b""])).pages()[0]
    task = {"text": "a long line of text", "x0": 100.0, "y0": 50.0, "x1": 140.0, "y1": 70.0, "size": 12}
    end = lambda doc: max(g[3] + g[5] * g[8] for g in drawn(doc).glyphs)
    small = writer.append(build([b""]), {0: writer.text_stream(page, [task])})
    assert abs(end(small) - 140) < 0.1 and drawn(small).glyphs[0][8] < 12
    tight = writer.append(build([b""]), {0: writer.text_stream(page, [task], "spacing")})
    assert b" 12.000 Tf" in tight and abs(max(g[3] for g in drawn(tight).glyphs) - 140) < 5
    many = writer.append(build([b""]), {0: writer.text_stream(page, [{**task, "multiline": True}])})
    assert shown(many) == "a long line of text" and len({g[4] for g in drawn(many).glyphs}) > 2
    turned = build([b""], page={"Rotate": 90})
    flipped = writer.append(turned, {0: writer.text_stream(Document(turned).pages()[0], [task])})
    assert abs(drawn(flipped).glyphs[0][3] - 100) < 0.01


def test_wrapping():
    lines = writer.wrapped("aaa bbb ccc\nddd", "Courier", 10, 50)
    assert lines == ["aaa bbb ", "ccc", "ddd"]
    assert writer.wrapped("abcdefghij", "Courier", 10, 30) == ["abcde", "fghij"]


def test_cleaned_pages():
    doc = writer.cleaned(build([text("gone"), text("stays")]), [0])
    assert shown(doc) == "" and shown(doc, 1) == "stays"


def test_save(spark, tmp_path):
    writer.save(frame(spark, build([text("x")])), str(tmp_path / "out"))
    assert shown((tmp_path / "out" / "0.pdf").read_bytes()) == "x"


def test_png():
    data = pixels.png(2, 1, b"\x01\x02\x03\x04\x05\x06", 3)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (2, 1)
    at = data.index(b"IDAT")
    assert zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]) == b"\0\x01\x02\x03\x04\x05\x06"
    assert pixels.image_bytes(1, 1, 8, "DeviceCMYK", "", b"\0\xff\0\0", None, None)[0] == "png" and pixels.to_rgb(b"\0\xff\0\0", "DeviceCMYK", None) == b"\xff\0\xff"
    assert pixels.image_bytes(1, 1, 8, "DeviceRGB", "DCTDecode", b"jpg", None, None) == ("jpeg", b"jpg")
    assert pixels.data_uri("png", b"x") == "data:image/png;base64,eA==" and json.dumps(pixels.data_uri("png", b""))


ODD = b"""BT /F1 10 Tf 14 TL 20 700 Td (start of all) Tj T* 1 Tc 3 Tw 50 Tz 4 Ts (a b  c) Tj [(xy z) -300 (w) 4 (qq)] TJ (line) ' 1 2 (more) " () Tj
0.9 0.4 -0.4 0.9 60 300 Tm (turned \\351\\222) Tj 0 1 -1 0 90 100 Tm (up) Tj /Span << /ActualText (hey) >> BDC (hello) Tj EMC -1 0 0 1 200 600 Tm (back) Tj ET
0 0 200 500 re W n BT /F1 0 Tf (none) Tj /F1 12 Tf 1 0 0 1 150 400 Tm (cut off by a clip \\000\\011\\255\\240) Tj ET"""


def test_strings_at_a_time_as_glyph_by_glyph(monkeypatch):
    """Glyphs and redacted bytes are the same, to the last bit, with and without the paths for whole strings."""
    zones = [Rect(0.0, 0.0, 60.0, 400.0), Rect(222.0, 100.0, 300.0, 900.0)]

    def all_of():
        out = []
        for rotate in (0, 90, 180):
            doc = build([ODD, text("Hello World", "second")], page={"Rotate": rotate})
            new = [writer.redact(doc, {0: zones, 1: zones[:1]}, least) for least in (0.0, 0.4)]
            out += new + [drawn(d, p).glyphs for d in (doc, *new) for p in (0, 1)]
        return out

    quick = all_of()
    assert any(len(x.raw) > 1 for x in drawn(build([ODD])).shown if isinstance(x, Run))
    monkeypatch.setattr(Font, "is_simple", False)
    pdffont._SHARED.clear()
    assert all_of() == quick and not any(isinstance(x, Run) for x in drawn(build([ODD])).shown)
    pdffont._SHARED.clear()


def test_zones_by_page_number_need_no_join(spark):
    docs = frame(spark, build([text("one", "two"), text("three")]), b"no file")
    top = writer.redact_pages(docs, lambda page: [Rect(0, 0, 600, 800)] if page == 0 else []).collect()
    assert shown(bytes(top[0].content)) == "" and shown(bytes(top[0].content), 1) == "three" and bytes(top[1].content) == b"no file"
    plan = files.pdf_redacted_text(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
