"""Document files as DataFrames: glyphs, images, drawings, fonts, pages and objects.

Each function maps the binary rows of a document table; a document is parsed within one task.
A document that cannot be read gives no rows but one in ``errors``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..operators import pages as arrays
from ..operators.pages import Glyphs
from .document import Document
from .interpreter import DRAWING_FIELDS, GLYPH_FIELDS, IMAGE_FIELDS, MAX_RUNS, Interpreter, columns, n_glyphs
from .pdffont import Font, read_glyph_list

GLYPHS = (
    "doc_id long, page_num long, seq long, c string, cp long, x double, y double, adv double, dx double, dy double, size double, asc double, dsc double, font string, color long, "
    "bold boolean, italic boolean, serif boolean, mono boolean, wmode int, bidi int, real_glyph boolean, new_obj boolean, after_image boolean"
)
IMAGES = "doc_id long, page_num long, seq long, name string, obj_id long, x0 double, y0 double, x1 double, y1 double, width int, height int, bpc int, colorspace string, filter string, decode array<double>, stream binary, smask binary, palette binary"
DRAWINGS = "doc_id long, page_num long, seq long, type string, path array<struct<cmd:string,points:array<struct<x:double,y:double>>>>, color long, fill long, line_width double, even_odd boolean, clip struct<x0:double,y0:double,x1:double,y1:double>"
FONTS = "doc_id long, page_num long, name string, obj_id long, base_font string, ascender double, descender double, wmode int, bold boolean, italic boolean, serif boolean, mono boolean, widths map<int,double>, unicode map<int,array<int>>"
PAGES = "doc_id long, page_num long, obj_id long, is_fallback boolean, rotate int, media struct<x0:double,y0:double,x1:double,y1:double>, crop struct<x0:double,y0:double,x1:double,y1:double>, width double, height double, is_encrypted boolean, repaired boolean"
OBJECTS = "doc_id long, obj_id long, kind string, offset long, container_id long, is_stream boolean, type string"
ERRORS = "doc_id long, error string"
#: Rows of one Arrow batch.
BATCH = 10_000


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a path or pattern: (doc_id, path, content); doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def _mapped(docs: DataFrame, ddl: str, rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = zip(*held, strict=True) if held else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, content, *more in zip(*batch.columns, strict=True):
                for row in rows(doc_id.as_py(), content.as_py() or b"", *(x.as_py() for x in more)):
                    held.append(row)
                    if len(held) >= BATCH:
                        yield out()
                        held = []
        yield out()

    more = ["part"] if "part" in docs.columns else []
    return docs.select(F.col("doc_id").cast("long"), F.col("content").cast("binary"), *more).mapInArrow(run, ddl)


def _pages_of(content: bytes, wanted: tuple[int, ...] | None, cmaps: str | None, names: str | None, share: tuple[int, int] = (0, 1), max_runs: int = MAX_RUNS):
    """Interpreted pages of a document; nothing if it cannot be read, and not the pages that fail."""
    try:
        doc = Document(content)
        pages, loaded, table = doc.pages(), {}, read_glyph_list(names) if names else None
    except Exception:  # a damaged document must not fail the job; errors() tells
        return
    for page in pages:
        if (wanted is None or page.number in wanted) and page.number % share[1] == share[0]:
            try:
                yield page, Interpreter(doc, page, cmaps, table, loaded, max_runs).run()
            except Exception:
                continue


def glyphs(docs: DataFrame, pages: tuple[int, ...] | None = None, cmap_folder: str | None = None, glyph_list: str | None = None, split: int = 1, max_runs: int = MAX_RUNS) -> DataFrame:
    """The glyph stream of (doc_id, content) rows, in top-down page space; only ``pages`` are interpreted.

    A page's content streams after the first ``max_runs`` are left out; ``errors`` names such pages.

    With ``split`` above one, every document goes to so many tasks, each of which interprets its share of the
    pages: for few large documents.
    """
    if split > 1:
        dealt = docs.select("doc_id", "content", F.explode(F.sequence(F.lit(0), F.lit(split - 1))).alias("part")).repartition(split, "part")
        return _mapped(dealt, GLYPHS, lambda d, content, part: ((d, page.number, *g) for page, out in _pages_of(content, pages, cmap_folder, glyph_list, (part, split), max_runs) for g in out.glyphs))
    return _mapped(docs, GLYPHS, lambda d, content: ((d, page.number, *g) for page, out in _pages_of(content, pages, cmap_folder, glyph_list, max_runs=max_runs) for g in out.glyphs))


#: Glyphs of whole pages that are laid out at a time.
RUN = 1 << 16


def runs(batch: pa.RecordBatch, cmap_folder: str | None = None, glyph_list: str | None = None, max_runs: int = MAX_RUNS) -> Iterator[Glyphs]:
    """The glyphs of (doc_id, content) rows as arrays, some whole pages at a time."""
    held: list[tuple] = []
    n = 0
    for doc_id, content in zip(*batch.columns[:2], strict=True):
        for page, out in _pages_of(content.as_py() or b"", None, cmap_folder, glyph_list, max_runs=max_runs):
            if out.shown:
                held.append((doc_id.as_py(), page.number, out.shown))
                n += n_glyphs(out.shown)
            if n >= RUN:
                yield _arrays(held)
                held, n = [], 0
    if held:
        yield _arrays(held)


def _arrays(pages: list[tuple]) -> Glyphs:
    fonts, read = columns([x for _, _, shown in pages for x in shown])
    page = np.repeat(np.arange(len(pages)), [n_glyphs(shown) for _, _, shown in pages])
    return Glyphs(np.array([d for d, _, _ in pages], np.int64), np.array([n for _, n, _ in pages], np.int64), fonts, page, read)


PAGE_TEXTS = "doc_id long, page_num long, text string"


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function of ``page_texts`` on batches of (doc_id, content)."""

    def rows(g: Glyphs) -> list:
        g = arrays.with_blanks(arrays.with_lines(arrays.drop_overstrikes(g)))
        at = arrays.starts(g)
        return [*g.keys(at), arrays.texts(g, at)]

    return arrays.mapped(runs, rows, ["doc_id", "page_num", "text"])(batches)


def page_texts(docs: DataFrame) -> DataFrame:
    """Texts of the pages of (doc_id, content) rows, in drawing order, laid out within the task that reads the document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("content").cast("binary")).mapInArrow(text_batches, PAGE_TEXTS)


def images(docs: DataFrame, pages: tuple[int, ...] | None = None) -> DataFrame:
    return _mapped(docs, IMAGES, lambda d, content: ((d, page.number, *i) for page, out in _pages_of(content, pages, None, None) for i in out.images))


def drawings(docs: DataFrame, pages: tuple[int, ...] | None = None) -> DataFrame:
    return _mapped(docs, DRAWINGS, lambda d, content: ((d, page.number, *x) for page, out in _pages_of(content, pages, None, None) for x in out.drawings))


def _font_row(d: int, page: int, name: str, f: Font) -> tuple:
    return d, page, name, f.obj_id, f.base_font, f.ascent, f.descent, f.wmode, f.bold, f.italic, f.serif, f.mono, list(f.widths.items()), list(f.unicode.items())


def fonts(docs: DataFrame, pages: tuple[int, ...] | None = None, cmap_folder: str | None = None) -> DataFrame:
    """Fonts used on each page under their resource names, with their width and Unicode tables."""
    return _mapped(docs, FONTS, lambda d, content: (_font_row(d, page.number, n, f) for page, out in _pages_of(content, pages, cmap_folder, None) for n, f in out.fonts.items()))


def _opened(content: bytes) -> Document | None:
    try:
        return Document(content)
    except Exception:
        return None


def pages(docs: DataFrame) -> DataFrame:
    """Pages with their geometry."""
    keys = ("x0", "y0", "x1", "y1")

    def rows(d: int, content: bytes):
        if doc := _opened(content):
            for p in doc.pages():
                box = [dict(zip(keys, r, strict=True)) if r else None for r in (p.media, p.crop)]
                yield d, p.number, p.obj_id, p.is_fallback, p.rotate, *box, p.rect.width, p.rect.height, doc.is_encrypted, doc.repaired

    return _mapped(docs, PAGES, rows)


def objects(docs: DataFrame) -> DataFrame:
    """Indirect objects with where they stand."""
    from .syntax import Ref, Stream

    def rows(d: int, content: bytes):
        if doc := _opened(content):
            for n in sorted({*doc.offsets, *doc.packed}):
                got = doc.get(Ref(n))
                kind = doc.dict_of(got).get("Type")
                yield d, n, "offset" if n in doc.offsets else "packed", doc.offsets.get(n), doc.packed.get(n, (None,))[0] if n not in doc.offsets else None, isinstance(got, Stream), str(kind) if kind else None

    return _mapped(docs, OBJECTS, rows)


def errors(docs: DataFrame, max_runs: int = MAX_RUNS) -> DataFrame:
    """Documents that cannot be read, pages that fail and pages with content left out, each with the reason."""

    def rows(d: int, content: bytes):
        try:
            doc = Document(content)
            found = doc.pages()
        except Exception as x:
            yield d, f"{type(x).__name__}: {x}"
            return
        if not found:
            yield d, "no pages"
        for page in found:
            try:
                stopped = Interpreter(doc, page, max_runs=max_runs).run().stopped
            except Exception as x:
                yield d, f"page {page.number}: {type(x).__name__}: {x}"
                continue
            if stopped:
                yield d, f"page {page.number}: {stopped}"

    return _mapped(docs, ERRORS, rows)


class PdfSource(DataSource):
    """``spark.read.format("vellum_pdf").load(folder)``: glyphs of local document files.

    A filter on page_num is pushed into the reader, so other pages are never interpreted.
    For stores that only Spark reads, use ``read_files`` and ``glyphs``.
    """

    @classmethod
    def name(cls) -> str:
        return "vellum_pdf"

    def schema(self) -> str:
        return "path string, " + GLYPHS

    def reader(self, schema) -> DataSourceReader:
        return _PdfReader(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pages = options.get("path", ""), None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("page_num",):
                self.pages = (int(f.value),)
            else:
                yield f

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(f"{self.path}/**/*.pdf", recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_File(p) for p in found]

    def read(self, partition):
        from pathlib import Path
        from zlib import crc32

        content = Path(partition.path).read_bytes()
        for page, out in _pages_of(content, self.pages, None, None):
            for g in out.glyphs:
                yield (partition.path, crc32(partition.path.encode()), page.number, *g)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfSource)


assert len(GLYPHS.split(", ")) == 2 + len(GLYPH_FIELDS) and len(IMAGES.split(", ")) == 2 + len(IMAGE_FIELDS) and len(DRAWING_FIELDS) == 8
