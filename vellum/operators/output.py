"""Text modes: plain text, blocks, nested pages and JSON from laid-out characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fonts
from . import layout as L
from .layout import PAGE

BOX = ("x0", "y0", "x1", "y1")
MODES = ("text", "blocks", "dict", "rawdict", "json", "rawjson")


def spans(chars: DataFrame) -> DataFrame:
    """One row a span of characters numbered by ``with_spans`` and boxed by ``glyph_boxes``."""
    first = F.array_sort(F.collect_list(F.struct("seq", "c")))
    style = [F.min_by(c, "seq").alias(c) for c in ("font", "size", "color", "bold", "italic", "serif", "mono", "asc", "dsc", "x", "y")]
    box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    rows = chars.groupBy(*PAGE, "block_no", "line_no", "span_no").agg(first.alias("_c"), *style, *box)
    bits = fonts.style_bits(*[F.col(c) for c in ("italic", "serif", "mono", "bold")])
    return rows.select("*", F.concat_ws("", F.col("_c.c")).alias("text"), bits.alias("flags")).drop("_c")


def joined_lines(lines: DataFrame, any_hyphen: bool, name: str = "text") -> DataFrame:
    """Lines of ``line_texts`` put together by page, each ending in a newline unless joined.

    A joined line loses its last character: any hyphen, or with ``any_hyphen`` off only ``-``.
    """
    cut = F.left("text", F.char_length("text") - 1)
    end = F.when(~F.col("joined"), F.concat("text", F.lit("\n"))).otherwise(cut if any_hyphen else F.when(F.endswith("text", F.lit("-")), cut).otherwise(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct(*[c for c in ("rank", "line_no") if c in lines.columns], end.alias("t"))))
    return lines.groupBy(*PAGE).agg(parts.alias("_p")).select(*PAGE, F.concat_ws("", F.col("_p.t")).alias(name))


def page_text(chars: DataFrame, sort: bool = False, any_hyphen: bool = False) -> DataFrame:
    """Plain text of each page, in drawing order or (``sort``) in reading order of the blocks."""
    lines = L.line_texts(chars)
    if sort:
        order = L.reading_order(L.boxes(chars, "block_no")).select(*PAGE, "block_no", "rank")
        lines = lines.join(order, [*PAGE, "block_no"])
    return joined_lines(lines, any_hyphen)


def document_text(pages: DataFrame) -> DataFrame:
    """Page texts joined by form feeds."""
    parts = F.array_sort(F.collect_list(F.struct("page_num", "text")))
    return pages.groupBy("doc_id").agg(parts.alias("_p")).select("doc_id", F.concat_ws("\f", F.col("_p.text")).alias("text"))


def blocks(chars: DataFrame, sort: bool = False) -> DataFrame:
    """One row a block: box, text with a newline after each line, number from 0 in drawing order, type 0."""
    lines = L.line_texts(chars)
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.concat("text", F.lit("\n")).alias("t"))))
    texts = lines.groupBy(*PAGE, "block_no").agg(parts.alias("_p")).select(*PAGE, "block_no", F.concat_ws("", F.col("_p.t")).alias("text"))
    boxed = L.boxes(chars, "block_no")
    if sort:
        boxed = L.reading_order(boxed)
    rows = boxed.join(texts, [*PAGE, "block_no"])
    return rows.select(*PAGE, (F.col("block_no") - 1).alias("block_no"), F.lit(0).alias("type"), *BOX, "text", *(["rank"] if sort else []))


def blocks_with_images(chars: DataFrame, images: DataFrame) -> DataFrame:
    """Text blocks (type 0) and images (type 1) numbered together in drawing order."""
    start = chars.groupBy(*PAGE, (F.col("block_no") - 1).alias("block_no")).agg(F.min("seq").alias("_at"))
    texts = blocks(chars).join(start, [*PAGE, "block_no"]).drop("block_no")
    pictures = images.select(*PAGE, F.lit(1).alias("type"), *BOX, F.lit("").alias("text"), (F.col("seq") * 2).alias("_at"))
    order = Window.partitionBy(*PAGE).orderBy("_at")
    return texts.unionByName(pictures).withColumn("block_no", (F.row_number().over(order) - 1).cast("long")).drop("_at")


def _box(names: tuple[str, ...] = BOX) -> Column:
    return F.struct(*names).alias("bbox")


def page_dict(chars: DataFrame, with_chars: bool = False, sort: bool = False) -> DataFrame:
    """One row a page with nested blocks, lines, spans and, on demand, characters.

    Each level is a list sorted by its number (blocks by reading order with ``sort``).
    """
    numbered = L.with_spans(chars)
    flat = spans(numbered)
    if with_chars:
        one = F.struct("seq", "c", F.col("cp").alias("u"), F.struct("x", "y").alias("origin"), _box(), "bidi", "wmode", "synthetic")
        detail = numbered.groupBy(*PAGE, "line_no", "span_no").agg(F.array_sort(F.collect_list(one)).alias("chars"))
        flat = flat.join(detail, [*PAGE, "line_no", "span_no"])
    span = F.struct("span_no", "text", _box(), F.struct("x", "y").alias("origin"), "font", "size", F.col("asc").alias("ascender"), F.col("dsc").alias("descender"), "color", "flags", *(["chars"] if with_chars else []))
    union_box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    heads = numbered.groupBy(*PAGE, "block_no", "line_no").agg(F.min_by(F.struct("dx", "dy"), "seq").alias("dir"), F.min_by("wmode", "seq").alias("wmode"))
    lines = flat.groupBy(*PAGE, "block_no", "line_no").agg(F.array_sort(F.collect_list(span)).alias("spans"), *union_box).join(heads, [*PAGE, "block_no", "line_no"])
    line = F.struct("line_no", _box(), "wmode", "dir", "spans")
    nested = lines.groupBy(*PAGE, "block_no").agg(F.array_sort(F.collect_list(line)).alias("lines"), *union_box)
    ranked = L.reading_order(nested) if sort else nested.withColumn("rank", F.col("block_no"))
    block = F.struct("rank", (F.col("block_no") - 1).alias("number"), F.lit(0).alias("type"), _box(), "lines")
    return ranked.groupBy(*PAGE).agg(F.array_sort(F.collect_list(block)).alias("blocks"))


def page_json(pages: DataFrame) -> DataFrame:
    """Nested pages as JSON text, one row a page."""
    rest = [c for c in pages.columns if c != "doc_id"]
    return pages.select(*PAGE, F.to_json(F.struct(*rest)).alias("json"))


def document_json(pages: DataFrame) -> DataFrame:
    """A JSON array of the pages of each document."""
    parts = F.array_sort(F.collect_list(F.struct("page_num", "json")))
    return page_json(pages).groupBy("doc_id").agg(parts.alias("_p")).select("doc_id", F.concat(F.lit("["), F.concat_ws(",", F.col("_p.json")), F.lit("]")).alias("json"))


def text_in(chars: DataFrame, mode: str = "text", sort: bool = False) -> DataFrame:
    """Dispatch by mode, whatever its case; unknown modes are an error."""
    mode = mode.lower()
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    if mode == "text":
        return page_text(chars, sort)
    if mode == "blocks":
        return blocks(chars, sort)
    pages = page_dict(chars, with_chars=mode.startswith("raw"), sort=sort)
    return page_json(pages) if mode.endswith("json") else pages


def font_names(glyphs: DataFrame) -> DataFrame:
    """Distinct base fonts of each page, sorted."""
    name = fonts.normalize_name(F.col("font"))
    return glyphs.where("font <> ''").groupBy(*PAGE).agg(F.array_sort(F.collect_set(name)).alias("fonts"))


def looks_like_page(body: Column) -> Column:
    """Whether a stream's first 4096 characters show a text object."""
    head = F.substring(body, 1, 4096)
    shows = F.lit(False)
    for op in ("Tj", "TJ", "Tf", "Td", "Tm"):
        shows = shows | F.contains(head, F.lit(op))
    return F.contains(head, F.lit("BT")) & F.contains(head, F.lit("ET")) & shows


def rtl_counts(chars: DataFrame) -> DataFrame:
    """Per line, how many characters run right to left and the highest level: what decides on reordering."""
    w = Window.partitionBy(*PAGE, "line_no")
    return chars.withColumns({"n_rtl": F.count_if(F.col("bidi") % 2 == 1).over(w), "max_level": F.max("bidi").over(w)})
