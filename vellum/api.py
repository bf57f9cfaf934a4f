"""Documents and pages as objects over DataFrames.

``open`` plans, it does not read; every ``*_df`` method returns a DataFrame, and only the scalar
accessors of a page bring that page's result to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color, pixels
from .functions.geometry import Matrix, Rect
from .operators import bidi, dedupe, layout, output
from .sources import pdf, writer

__all__ = ["Document", "Matrix", "Page", "Rect", "measure_text_width", "open"]


def open(spark: SparkSession, source: str | bytes | DataFrame, cmap_folder: str | None = None) -> Document:
    """Documents of a path or pattern, of bytes, or of a DataFrame (doc_id, content)."""
    if isinstance(source, (bytes, bytearray)):
        source = spark.createDataFrame([(0, bytearray(source))], "doc_id long, content binary")
    elif isinstance(source, str):
        source = pdf.read_files(spark, source)
    return Document(source, cmap_folder)


def measure_text_width(text: str, font: str = "Helvetica", size: float = 12.0) -> float:
    from .sources.pdffont import standard_width

    return sum(standard_width(font, ord(c)) for c in text) * size


class Document:
    """A set of documents; with one document, its pages can be taken by index."""

    def __init__(self, docs: DataFrame, cmap_folder: str | None = None, options: layout.Options = layout.Options()):
        self.docs, self.cmap_folder, self.options = docs, cmap_folder, options
        self._cached: dict[tuple, DataFrame] = {}

    # ---- tables ----

    def _kept(self, name: str, pages: tuple[int, ...] | None, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that is kept until ``close``: later steps read it several times, and files are slow to parse."""
        if (name, pages) not in self._cached:
            self._cached[name, pages] = make().persist()
        return self._cached[name, pages]

    def glyphs_df(self, pages: tuple[int, ...] | None = None) -> DataFrame:
        return self._kept("glyphs", pages, lambda: pdf.glyphs(self.docs, pages, self.cmap_folder))

    def clear_page_cache(self) -> None:
        for kept in self._cached.values():
            kept.unpersist()
        self._cached.clear()

    close = clear_page_cache

    def chars_df(self, pages: tuple[int, ...] | None = None) -> DataFrame:
        """Laid-out characters: overprints merged, blanks put in, right-to-left lines in reading order, duplicates gone."""
        glyphs = self.glyphs_df(pages)
        if self.options.collect_styles:
            glyphs = self._kept("styled", pages, lambda: dedupe.merge_fake_bold(self.glyphs_df(pages)))
        placed = self._kept("placed", pages, lambda: layout.glyph_boxes(layout.laid_out(glyphs, self.options)))
        ordered = self._kept("ordered", pages, lambda: bidi.reordered(placed))
        once = self._kept("once", pages, lambda: dedupe.remove_duplicates(ordered))
        return self._kept("chars", pages, lambda: dedupe.drop_blank_lines(once))

    def pages_df(self) -> DataFrame:
        return pdf.pages(self.docs)

    def images_df(self, pages: tuple[int, ...] | None = None) -> DataFrame:
        """Images with their data URI."""
        found = pdf.images(self.docs, pages)
        return found.withColumn("image", pixels.image_uri("width", "height", "bpc", "colorspace", "filter", "stream", "smask", "palette"))

    def drawings_df(self, pages: tuple[int, ...] | None = None) -> DataFrame:
        return pdf.drawings(self.docs, pages)

    def fonts_df(self, pages: tuple[int, ...] | None = None) -> DataFrame:
        """Base font of each resource name of each page."""
        found = pdf.fonts(self.docs, pages, self.cmap_folder).where("base_font <> ''")
        return found.groupBy("doc_id", "page_num").agg(F.map_from_entries(F.collect_list(F.struct("name", "base_font"))).alias("fonts"))

    def errors_df(self) -> DataFrame:
        return pdf.errors(self.docs)

    # ---- text ----

    def page_text_df(self, mode: str = "text", sort: bool = False, pages: tuple[int, ...] | None = None, web_colors: bool = False) -> DataFrame:
        """Any of the modes; ``web_colors`` gives ``#RRGGBB`` in place of numbers."""
        chars = self.chars_df(pages)
        if web_colors:
            chars = chars.withColumn("color", color.hex_string(F.col("color")))
        return output.text_in(chars, mode, sort)

    def text_df(self) -> DataFrame:
        """One text a document, pages joined by form feeds; a page without text is empty between them."""
        texts = self.pages_df().select("doc_id", "page_num").join(output.page_text(self.chars_df()), ["doc_id", "page_num"], "left")
        return output.document_text(texts.select("doc_id", "page_num", F.coalesce("text", F.lit("")).alias("text")))

    def dict_df(self, include_chars: bool = False, sort: bool = False) -> DataFrame:
        return output.page_dict(self.chars_df(), include_chars, sort)

    def get_all_text(self) -> str:
        return self.text_df().first().text

    def get_all_dicts_json(self, include_chars: bool = False, sort: bool = False) -> str:
        return output.document_json(self.dict_df(include_chars, sort)).first().json

    def extract_text(self) -> DataFrame:
        """Page texts in which joined lines lose any kind of hyphen."""
        return output.page_text(self.chars_df(), any_hyphen=True)

    def get_page_font_basenames(self, page: int) -> dict[str, str]:
        row = self.fonts_df((page,)).where(F.col("page_num") == page).first()
        return dict(row.fonts) if row else {}

    # ---- changes: each gives a new Document ----

    def _with(self, docs: DataFrame) -> Document:
        return Document(docs, self.cmap_folder, self.options)

    def redact(self, zones: DataFrame, min_overlap: float = 0.0) -> Document:
        return self._with(writer.redact_documents(self.docs, zones, min_overlap))

    def redact_pages(self, zones: dict[int, list[tuple[float, float, float, float]]], min_overlap: float = 0.0) -> Document:
        """The same zones for every document, by page number."""
        rows = [(n, *map(float, z)) for n, zs in zones.items() for z in zs]
        table = self.docs.sparkSession.createDataFrame(rows, "page_num int, x0 double, y0 double, x1 double, y1 double")
        return self.redact(self._for_all(table), min_overlap)

    def redact_rects(self, page: int, rects: list[tuple[float, float, float, float]]) -> Document:
        return self.redact_pages({page: rects})

    def _for_all(self, tasks: DataFrame) -> DataFrame:
        """Tasks stated once, for every document: as one array column."""
        rows = [r.asDict() for r in tasks.collect()]
        kind = f"array<{tasks.schema.simpleString()}>"
        import json

        listed = F.from_json(F.lit(json.dumps(rows)), kind)
        return self.docs.select("doc_id", F.inline(listed))

    def insert_text(self, tasks: DataFrame, fit: str = "size") -> Document:
        return self._with(writer.insert_text(self.docs, tasks, fit))

    def insert_rects(self, tasks: DataFrame) -> Document:
        return self._with(writer.insert_rects(self.docs, tasks))

    def save(self, folder: str) -> None:
        writer.save(self.docs, folder)

    def tobytes(self) -> bytes:
        return bytes(self.docs.select("content").first().content)

    # ---- pages of one document ----

    def __len__(self) -> int:
        return self.pages_df().count()

    @property
    def is_encrypted(self) -> bool:
        row = self.pages_df().select("is_encrypted").first()
        return bool(row and row.is_encrypted)

    def __getitem__(self, index: int) -> Page:
        n = len(self)
        if not -n <= index < n:
            raise IndexError(index)
        return Page(self, index % n)

    def __iter__(self):
        return (Page(self, i) for i in range(len(self)))


class Page:
    """One page, numbered from 0."""

    def __init__(self, parent: Document, number: int):
        self.parent, self.number = parent, number

    def text_df(self, mode: str = "text", sort: bool = False) -> DataFrame:
        return self.parent.page_text_df(mode, sort, (self.number,)).where(F.col("page_num") == self.number)

    def get_text(self, mode: str = "text", sort: bool = False):
        """Text, JSON text, a list of block rows, or a nested row, by mode."""
        rows = self.text_df(mode, sort)
        if mode.lower() == "blocks":
            return rows.orderBy("rank" if sort else "block_no").collect()
        row = rows.first()
        if row is None:
            return "" if mode.lower() == "text" else None
        return row["text"] if mode.lower() == "text" else row["json"] if mode.lower().endswith("json") else row

    def get_images(self) -> list:
        return self.parent.images_df((self.number,)).orderBy("seq").collect()

    def get_drawings(self) -> list:
        return self.parent.drawings_df((self.number,)).orderBy("seq").collect()

    def get_images_json(self) -> str:
        rows = self.parent.images_df((self.number,)).select("seq", F.to_json(F.struct("name", "width", "height", "bpc", "colorspace", "filter", "image")).alias("j"))
        return "[" + ",".join(r.j for r in rows.orderBy("seq").collect()) + "]"

    @property
    def rect(self) -> Rect:
        row = self.parent.pages_df().where(F.col("page_num") == self.number).first()
        return Rect(0.0, 0.0, row.width, row.height)

    def redact_text(self, rects: list, min_overlap: float = 0.0) -> Document:
        return self.parent.redact_pages({self.number: rects}, min_overlap)

    def clean_contents(self) -> Document:
        from pyspark.sql.types import BinaryType

        cleaned = F.udf(lambda c, n=self.number: bytearray(writer.cleaned(bytes(c), [n])), BinaryType())
        return self.parent._with(self.parent.docs.withColumn("content", cleaned("content")))
