import pytest

import vellum.api as api
from vellum.functions.geometry import Matrix, Rect
from vellum.streaming import drop

from .pdfmaker import build, text


def test_document_and_pages(spark):
    doc = api.open(spark, build([text("Hello World"), b"", text("last")]))
    assert len(doc) == 3 and doc.get_all_text() == "Hello World\n\f\flast\n"
    assert doc[0].get_text() == "Hello World\n" and doc[-1].get_text("TEXT") == "last\n" and doc[1].get_text() == ""
    assert doc[0].get_text("blocks")[0].text == "Hello World\n" and doc[0].get_text("dict").blocks[0].lines[0].spans[0].text == "Hello World"
    assert doc.get_all_dicts_json().startswith("[") and doc[0].rect == Rect(0, 0, 600, 800) and not doc.is_encrypted
    assert doc.get_page_font_basenames(0) == {"F1": "Helvetica"}
    assert '"color":"#000000"' in doc.page_text_df("json", web_colors=True).first().json
    with pytest.raises(IndexError):
        doc[3]
    assert doc[0].get_images() == [] and doc[0].get_images_json() == "[]" and doc[0].get_drawings() == []


def test_changes_give_new_documents(spark):
    doc = api.open(spark, build([text("Hello"), text("Bye")]))
    assert doc.redact_pages({0: [(0, 0, 600, 800)]}).get_all_text() == "\fBye\n"
    assert doc[1].redact_text([(0, 0, 600, 800)]).get_all_text() == "Hello\n\f" and doc.get_all_text() == "Hello\n\fBye\n"
    assert doc[0].clean_contents()[0].get_text() == ""
    doc.clear_page_cache()
    assert doc.get_all_text() == "Hello\n\fBye\n"
    doc.close()


def test_duplicates_are_dropped(spark):
    twice = b"BT /F1 10 Tf 50 700 Td (Hi) Tj ET BT /F1 10 Tf 50.4 700 Td (Hi) Tj ET BT /F1 10 Tf 50 600 Td (x) Tj ET"
    doc = api.open(spark, build([twice]))
    assert doc.get_all_text() == "Hi\nx\n"
    assert doc[0].get_text("dict").blocks[0].lines[0].spans[0].flags & 16


def test_plain_geometry():
    m = Matrix(2, 0, 0, 3, 5, 7)
    assert (m * m.inverse()).at(4, 9) == pytest.approx((4, 9)) and m.box(Rect(0, 0, 1, 1)) == Rect(5, 7, 7, 10)
    assert (Rect(0, 0, 4, 4) & Rect(2, 2, 6, 6)) == Rect(2, 2, 4, 4) and (Rect(0, 0, 1, 1) & Rect(2, 2, 3, 3)).is_empty
    assert api.measure_text_width("AB", "Courier", 10) == 12


def test_streamed_folder(spark, tmp_path):
    for d in ("in", "out", "ck"):
        (tmp_path / d).mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(build([text("streamed")]))
    query = drop.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    query.awaitTermination(60)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["streamed\n"]
    query = drop.glyph_stream(spark, str(tmp_path / "in"), str(tmp_path / "g"), str(tmp_path / "ck2"), once=True)
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "g")).count() == len("streamed")
