"""Changes to documents: incremental updates, redaction, inserted text and rectangles.

The original bytes stay in front; changed and new objects, a cross-reference table and a
trailer are appended.  One row is one document; its pages are rewritten within the task.
"""

from __future__ import annotations

import copy
import functools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Matrix, Rect
from ..operators.insert import BOLD_STROKE, ITALIC_SKEW, LINE_STEP, RECT_PAD
from ..operators.redact import MARGIN
from . import pdffont
from .document import Document, Page
from .interpreter import Interpreter, Moved, State
from .syntax import Name, Ref, Stream, operations, write

FONT_FACES = {(False, False): "Helvetica", (True, False): "Helvetica-Bold", (False, True): "Helvetica-Oblique", (True, True): "Helvetica-BoldOblique"}


def runs(ids: list[int]) -> list[tuple[int, int]]:
    """Consecutive numbers as (first, count)."""
    out: list[tuple[int, int]] = []
    for n in sorted(set(ids)):
        if out and sum(out[-1]) == n:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((n, 1))
    return out


def incremental(doc: Document, changed: dict[int, object]) -> bytes:
    """The document with these objects replaced or added."""
    if not changed:
        return doc.data
    out, places = bytearray(doc.data), {}
    if not out.endswith(b"\n"):
        out += b"\n"
    for n in sorted(changed):
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + write(changed[n]) + b"\nendobj\n"
    at = len(out)
    out += b"xref\n"
    for first, count in runs(list(places)):
        out += b"%d %d\n" % (first, count) + b"".join(b"%010d 00000 n \n" % places[n] for n in range(first, first + count))
    trailer = {"Size": max(doc.max_id, *changed) + 1, "Root": doc.trailer.get("Root")} | {k: doc.trailer[k] for k in ("Info", "ID") if k in doc.trailer}
    if not doc.repaired:
        trailer["Prev"] = doc.start
    else:  # nothing to go back to: the table must name every object
        return _rewritten(doc, changed)
    out += b"trailer\n" + write(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def _rewritten(doc: Document, changed: dict[int, object]) -> bytes:
    """A whole new file of all objects, for documents whose cross references are lost."""
    every = {n: doc.get(Ref(n)) for n in {*doc.offsets, *doc.packed}} | changed
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for n in sorted(every):
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + write(every[n]) + b"\nendobj\n"
    at = len(out)
    out += b"xref\n"
    for first, count in runs(list(places)):
        out += b"%d %d\n" % (first, count) + b"".join(b"%010d 00000 n \n" % places[n] for n in range(first, first + count))
    out += b"trailer\n" + write({"Size": max(every) + 1, "Root": doc.trailer.get("Root")}) + b"\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


# ---- redaction ------------------------------------------------------------------------------

#: Rectangles by page number, or a function that gives those of a page number.
Zones = dict[int, list[Rect]] | Callable[[int], list[Rect]]


def _moved(raw: bytes, font: pdffont.Font, st: State, tm) -> Moved:
    return Moved(raw, (font, st.size, st.char_space, st.word_space, st.scale), tm)


#: Bytes of streams whose operators are kept between the passes.
KEPT = 1 << 20


def _parsed(loaded: dict, data: bytes) -> list[tuple[str, list]]:
    """Operators of a stream, kept for the second pass unless a document's streams are large."""
    kept = loaded.setdefault("operations", {})
    if data in kept:
        return kept[data]
    found = list(operations(data, inline=True))
    if sum(map(len, kept)) + len(data) <= KEPT:
        kept[data] = found
    return found


class _Finder(Interpreter):
    """First pass: which glyphs of which stream a zone touches, over all places a form is drawn at."""

    def __init__(self, doc: Document, page: Page, zones: list[Rect], min_overlap: float, gone: dict, **how):
        super().__init__(doc, page, **how)
        self.zones, self.min_overlap, self.gone = zones, min_overlap, gone
        self.key, self.count = ("page", page.obj_id), 0

    def _operations(self, data: bytes) -> Iterator[tuple[str, list]]:
        return iter(_parsed(self.loaded, data))

    def _form(self, ref, got: Stream, resources: dict, st: State, depth: int) -> None:
        outer = self.key, self.count
        self.key, self.count = ("form", ref.number if isinstance(ref, Ref) else 0), 0
        super()._form(ref, got, resources, st, depth)
        self.key, self.count = outer

    def _show(self, raw, st, tm, actual):
        font = st.font or pdffont.Font(widths={})
        if font.is_simple:
            if raw and not self._apart(font, st, tm):
                self.gone[self.key].update((np.flatnonzero(self._hits(raw, font, st, tm)) + self.count).tolist())
            self.count += len(raw)
            return _moved(raw, font, st, tm)
        placed, tm = self._placed(raw, st, tm)
        for _, _, adv, at in placed:
            box = Rect(-0.5, 0.0, 0.5, -adv) if font.wmode else Rect(0.0, font.descent, adv, font.ascent)
            if self._hit((at * self.to_page).box(box)):
                self.gone[self.key].add(self.count)
            self.count += 1
        return tm

    def _apart(self, font: pdffont.Font, st: State, tm) -> bool:
        """Whether a string along the page's lines lies above or below all zones, wherever on its line its glyphs are."""
        along, to = tm * st.ctm, self.to_page
        if along.b or to.b:
            return False
        y0, y1 = self._reach(font, st, along)
        dy = (y1 - y0) * MARGIN
        return not any(y0 + dy <= z.y1 and y1 - dy >= z.y0 for z in self.zones)

    def _reach(self, font: pdffont.Font, st: State, along: Matrix) -> tuple[float, float]:
        """Top and bottom of the glyphs of a string along the page's lines."""
        up, f = st.size * along.d * self.to_page.d, (st.rise * along.d + along.f) * self.to_page.d + self.to_page.f
        y0, y1 = up * font.descent + f, up * font.ascent + f
        return (y0, y1) if y0 < y1 else (y1, y0)

    def _hits(self, raw: bytes, font: pdffont.Font, st: State, tm) -> np.ndarray:
        """As ``_hit``, of all glyphs of a string in a simple font."""
        adv, at, x, y = self._places(raw, font, st, tm)
        m, to, along = at * self.to_page, self.to_page, tm * st.ctm
        if along.b or to.b or m.c or to.c:
            e, f = to.a * x + to.c * y + to.e, to.b * x + to.d * y + to.f
            corners = [(m.a * px + m.c * py + e, m.b * px + m.d * py + f) for px in (0.0, adv) for py in (font.descent, font.ascent)]
            (x0, y0), (x1, y1) = ([functools.reduce(of, side) for side in zip(*corners, strict=True)] for of in (np.minimum, np.maximum))
        else:
            e = to.a * x + to.e
            ends = m.a * adv + e
            x0, x1 = np.minimum(e, ends), np.maximum(e, ends)
            y0, y1 = self._reach(font, st, along)
        dx, dy = (x1 - x0) * MARGIN, (y1 - y0) * MARGIN
        out = np.zeros(len(raw), bool)
        for z in self.zones:
            hit = (x0 + dx <= z.x1) & (x1 - dx >= z.x0) & (y0 + dy <= z.y1) & (y1 - dy >= z.y0)
            if self.min_overlap > 0:
                common = np.maximum(np.minimum(x1, z.x1) - np.maximum(x0, z.x0), 0) * np.maximum(np.minimum(y1, z.y1) - np.maximum(y0, z.y0), 0)
                hit &= common >= self.min_overlap * (x1 - x0) * (y1 - y0)
            out |= hit
        return out

    def _hit(self, b: Rect) -> bool:
        dx, dy = b.width * MARGIN, b.height * MARGIN
        for z in self.zones:
            if b.x0 + dx <= z.x1 and b.x1 - dx >= z.x0 and b.y0 + dy <= z.y1 and b.y1 - dy >= z.y0:
                common = b & z
                if self.min_overlap <= 0 or common.width * common.height >= self.min_overlap * b.width * b.height:
                    return True
        return False


class _Filter(Interpreter):
    """Second pass: the streams again, without the glyphs that go; their advance becomes kerning."""

    def __init__(self, doc: Document, page: Page, gone: dict, **how):
        super().__init__(doc, page, **how)
        self.gone, self.key, self.count = gone, ("page", page.obj_id), 0
        self.written: dict[tuple, bytes] = {}
        self.parts: list[bytes] = []
        self.items: list = []
        self.removed = 0
        self.last: dict[tuple, int] = {}  # glyph to go of each stream

    def _form(self, ref, got: Stream, resources: dict, st: State, depth: int) -> None:
        outer = self.key, self.count, self.parts
        self.key, self.count, self.parts = ("form", ref.number if isinstance(ref, Ref) else 0), 0, []
        super()._form(ref, got, resources, st, depth)
        self.written[self.key] = b"\n".join(self.parts)
        self.key, self.count, self.parts = outer

    def _operations(self, data: bytes) -> Iterator[tuple[str, list]]:
        spans: list[tuple[int, int, list]] = []
        for op, ops in _parsed(self.loaded, data):
            self.items, before = [], self.removed
            yield op, ops
            if op == "BI":
                self.parts.append(b"BI" + ops[0])
            elif op in ("Tj", "TJ", "'", '"') and ops:
                self.parts.append(self._text_operator(op, ops, before))
            else:
                self.parts.append(b" ".join([*map(write, ops), op.encode("latin-1")]))
                if op in ("BDC", "BMC"):
                    spans.append((len(self.parts) - 1, self.removed, ops))
                elif op == "EMC" and spans:
                    at, then, opened = spans.pop()
                    if self.removed > then and opened and isinstance(opened[-1], dict) and "ActualText" in opened[-1]:
                        bare = {k: v for k, v in opened[-1].items() if k not in ("ActualText", "Alt", "E")}
                        self.parts[at] = b" ".join([*map(write, [*opened[:-1], bare]), b"BDC"])

    def _text_operator(self, op: str, ops: list, before: int) -> bytes:
        if self.removed == before:
            return b" ".join([*map(write, ops), op.encode()])
        lead = b""
        if op == '"' and len(ops) >= 3:
            lead = b"%s Tw %s Tc T* " % (write(ops[0]), write(ops[1]))
        elif op == "'":
            lead = b"T* "
        items: list = []
        queue = list(self.items)
        for part in ops[-1] if op == "TJ" and isinstance(ops[-1], list) else [ops[-1]]:
            items += queue.pop(0) if isinstance(part, bytes) and queue else [part]
        return lead + write(items) + b" TJ"

    def _show(self, raw, st, tm, actual):
        font = st.font or pdffont.Font(widths={})
        if font.is_simple:
            self.items.append(self._left(raw, font, st, tm))
            self.count += len(raw)
            return _moved(raw, font, st, tm)
        placed, after = self._placed(raw, st, tm)
        items, kept, skip, at = [], b"", 0.0, 0
        for _, n, adv, _ in placed:
            if self.count in self.gone[self.key]:
                if kept:
                    items, kept = [*items, kept], b""
                skip -= adv * 1000
                self.removed += 1
            else:
                if skip:
                    items, skip = [*items, round(skip, 3)], 0.0
                kept += raw[at : at + n]
            at += n
            self.count += 1
        self.items.append([*items, *([kept] if kept else []), *([round(skip, 3)] if skip else [])])
        return after


    def _left(self, raw: bytes, font: pdffont.Font, st: State, tm) -> list:
        """What is left of a string in a simple font: stretches that stay, and kerning for those that go."""
        gone, these = self.gone[self.key], range(self.count, self.count + len(raw))
        if self.key not in self.last:
            self.last[self.key] = max(gone, default=-1)
        if self.count > self.last[self.key] or gone.isdisjoint(these):
            return [raw] if raw else []
        skips = -(self._advances(raw, font, st)[0] * 1000)
        goes = np.ones(len(raw), bool) if gone.issuperset(these) else np.array([k in gone for k in these])
        ends = [0, *(np.flatnonzero(goes[1:] != goes[:-1]) + 1).tolist(), len(raw)]
        self.removed += int(goes.sum())
        items: list = []
        for lo, hi in zip(ends, ends[1:], strict=False):
            if not goes[lo]:
                items.append(raw[lo:hi])
            elif skip := float(np.add.accumulate(skips[lo:hi])[-1]):
                items.append(round(skip, 3))
        return items


def redact(content: bytes, zones: Zones, min_overlap: float = 0.0, cmap_folder: str | None = None) -> bytes:
    """The document without the text under the zones (in top-down page space).

    What is left keeps its place.  A form drawn several times loses the union of what its places lose.
    """
    return _redact(Document(content), zones, min_overlap, cmap_folder)


def _redact(doc: Document, zones: Zones, min_overlap: float = 0.0, cmap_folder: str | None = None) -> bytes:
    pages, gone, loaded = doc.pages(), defaultdict(set), {}
    of_page = zones if callable(zones) else lambda number: zones.get(number, [])
    for page in pages:
        if found := of_page(page.number):
            _Finder(doc, page, found, min_overlap, gone, cmap_folder=cmap_folder, loaded=loaded).run()
    changed: dict[int, object] = {}
    forms = any(found for (kind, _), found in gone.items() if kind == "form")
    for page in pages:  # a form is shared, so where one loses glyphs every page is looked at, whatever its zones
        if not forms and not gone["page", page.obj_id]:
            continue
        work = _Filter(doc, page, gone, cmap_folder=cmap_folder, loaded=loaded)
        work.run()
        for (kind, n), body in work.written.items():
            if kind == "form" and gone[kind, n] and n:
                changed[n] = Stream(_plain(doc.dict_of(Ref(n))), body)
        if gone["page", page.obj_id] and page.obj_id:
            new = max(doc.max_id, *changed, 0) + 1 if changed else doc.max_id + 1
            changed[new] = Stream({}, b"\n".join(work.parts))
            raw = doc.dict_of(Ref(page.obj_id))
            changed[page.obj_id] = Stream(_plain(raw), changed.pop(new).raw) if page.is_fallback else {**raw, "Contents": Ref(new)}
    return incremental(doc, changed)


def _plain(info: dict) -> dict:
    return {k: v for k, v in info.items() if k not in ("Filter", "DecodeParms", "Length", "F", "DP")}


# ---- insertion ------------------------------------------------------------------------------


def _width(text: str, face: str, size: float) -> float:
    return sum(pdffont.standard_width(face, c) for c in text.encode("cp1252", "replace")) * size


def wrapped(text: str, face: str, size: float, limit: float) -> list[str]:
    """Lines: breaks at newlines and, where a line would outgrow the limit, after its last blank, or right there."""
    lines = []
    for paragraph in text.split("\n"):
        line = ""
        for c in paragraph:
            if line and _width(line + c, face, size) > limit:
                cut = len(line) if c == " " else line.rfind(" ") + 1 or len(line)
                lines.append(line[:cut])
                line = line[cut:]
            line += c
        lines.append(line)
    return lines if lines[-1:] != [""] else lines[:-1]


def text_stream(page: Page, tasks: list[dict], fit: str = "size") -> tuple[bytes, set[str]]:
    """Content that draws text tasks, and the faces it uses.

    A line that is too wide gets a smaller size, or with ``fit`` "spacing" is squeezed; multiline
    tasks are wrapped instead.
    """
    back, out, faces = page.matrix.inverse(), [], set()
    for t in tasks:
        size, width = float(t.get("size") or 12), t["x1"] - t["x0"]
        face = FONT_FACES[bool(t.get("bold")), bool(t.get("italic"))]
        squeeze, text = 1.0, (t.get("text") or "")
        if t.get("multiline"):
            lines = wrapped(text, face, size, width)
        else:
            lines = [text.replace("\n", " ")] if text else []
            total = _width(lines[0], face, size) if lines else 0.0
            if total > width and total > 0 and fit == "spacing":
                squeeze = width / total
            elif total > width and total > 0:
                size *= width / total
        lead = t["y1"] - t["y0"] - size
        y = min(t["y0"] + max(0.0, lead / 2) + size * 0.8, t["y1"])
        faces.add(face)
        color = " ".join(f"{max(0, min(255, int(t.get(k) or 0))) / 255:.3f}" for k in "rgb")
        out.append(f"BT {color} rg /{_resource(face)} {size:.3f} Tf".encode())
        for line in lines:
            px, py = back.at(t["x0"], y)
            out.append(f"{squeeze:.4f} 0 0 1 {px:.3f} {py:.3f} Tm ".encode() + write(line.encode("cp1252", "replace")) + b" Tj")
            y += size * LINE_STEP
        out.append(b"ET")
    return b"\n".join(out), faces


def _resource(face: str) -> str:
    return "Vl" + face.replace("-", "")


def rects_stream(page: Page, tasks: list[dict]) -> bytes:
    """Content that fills rectangles, grown by their padding."""
    back, out = page.matrix.inverse(), []
    for t in tasks:
        pad = RECT_PAD if t.get("pad") is None else float(t["pad"])
        box = back.box(Rect(t["x0"] - pad, t["y0"] - pad, t["x1"] + pad, t["y1"] + pad))
        color = [max(0, min(255, int(t.get(k) or 0))) / 255 for k in "rgb"]
        out.append("{:.3f} {:.3f} {:.3f} rg\n{:.3f} {:.3f} {:.3f} {:.3f} re\nf".format(*color, box.x0, box.y0, box.width, box.height))
    return "\n".join(out).encode()


def append(content: bytes, additions: dict[int, tuple[bytes, set[str]]]) -> bytes:
    """The document with content drawn over its pages; what was there is enclosed, so its state does not leak."""
    doc = Document(content)
    changed, new = {}, doc.max_id
    faces: dict[str, Ref] = {}
    for page in doc.pages():
        if page.number not in additions or not page.obj_id or page.is_fallback:
            continue
        body, wanted = additions[page.number]
        for face in wanted - set(faces):
            new += 1
            faces[face] = Ref(new)
            changed[new] = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(face), "Encoding": Name("WinAnsiEncoding")}
        opened, closed = new + 1, new + 2
        new += 2
        changed[opened], changed[closed] = Stream({}, b"q\n"), Stream({}, b"\nQ\n" + body + b"\n")
        raw = doc.dict_of(Ref(page.obj_id))
        old = doc.get(raw.get("Contents"))
        old = old if isinstance(old, list) else [raw["Contents"]] if "Contents" in raw else []
        resources = copy.copy(doc.dict_of(page.info.get("Resources")))
        if wanted:
            resources["Font"] = {**doc.dict_of(resources.get("Font")), **{_resource(f): faces[f] for f in wanted}}
        changed[page.obj_id] = {**raw, "Contents": [Ref(opened), *old, Ref(closed)], "Resources": resources}
    return incremental(doc, changed)


def cleaned(content: bytes, pages: list[int]) -> bytes:
    """The document with nothing drawn on these pages."""
    doc, changed = Document(content), {}
    new = doc.max_id + 1
    for page in doc.pages():
        if page.number in pages and page.obj_id:
            changed[new] = Stream({}, b"")
            changed[page.obj_id] = {**doc.dict_of(Ref(page.obj_id)), "Contents": Ref(new)}
    return incremental(doc, changed)


# ---- over DataFrames ------------------------------------------------------------------------


def _changed(docs: DataFrame, tasks: DataFrame, change: Callable[[bytes, dict[int, list[dict]]], bytes]) -> DataFrame:
    """Rows (doc_id, content) changed by their tasks; tasks are gathered by document, and a document without any stays as it is."""
    rest = [c for c in tasks.columns if c != "doc_id"]
    lists = tasks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("tasks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                by_page: dict[int, list[dict]] = defaultdict(list)
                for t in found or []:
                    by_page[t["page_num"]].append(t)
                out.append(change(content, by_page) if by_page and content else content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])

    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content")).join(lists, "doc_id", "left")
    return both.select("doc_id", "content", "tasks").mapInArrow(run, "doc_id long, content binary")


def redact_documents(docs: DataFrame, zones: DataFrame, min_overlap: float = 0.0) -> DataFrame:
    """(doc_id, content) with the text under ``zones`` (doc_id, page_num, x0, y0, x1, y1) removed."""
    return _changed(docs, zones.select("doc_id", "page_num", "x0", "y0", "x1", "y1"), lambda c, pages: redact(c, {n: [Rect(z["x0"], z["y0"], z["x1"], z["y1"]) for z in zs] for n, zs in pages.items()}, min_overlap))


def redactor(zones: Callable[[int], list[Rect]], min_overlap: float = 0.0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of ``redact_pages`` on batches of (doc_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_redacted(c.as_py(), zones, min_overlap) for c in batch.column(1)], pa.binary())], ["doc_id", "content"])

    return run


def redact_pages(docs: DataFrame, zones: Callable[[int], list[Rect]], min_overlap: float = 0.0) -> DataFrame:
    """As ``redact_documents``, with zones that a page's number tells: no table of them is made or joined. A document that cannot be read stays as it is."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content")).mapInArrow(redactor(zones, min_overlap), "doc_id long, content binary")


def _redacted(content: bytes | None, zones: Callable[[int], list[Rect]], min_overlap: float) -> bytes | None:
    try:
        doc = Document(content or b"")
        doc.pages()
    except Exception:  # pdf.errors tells
        return content
    return _redact(doc, zones, min_overlap) if content else content


def insert_text(docs: DataFrame, tasks: DataFrame, fit: str = "size") -> DataFrame:
    """(doc_id, content) with text drawn: ``tasks`` has doc_id, page_num, seq, text, x0, y0, x1, y1 and may have size, r, g, b, bold, italic, multiline."""
    first = [c for c in ("doc_id", "page_num", "seq") if c in tasks.columns]
    ordered = tasks.select(*first, *[c for c in tasks.columns if c not in first])

    def change(content: bytes, pages: dict[int, list[dict]]) -> bytes:
        doc = {p.number: p for p in Document(content).pages()}
        return append(content, {n: text_stream(doc[n], ts, fit) for n, ts in pages.items() if n in doc})

    return _changed(docs, ordered, change)


def insert_rects(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """(doc_id, content) with rectangles filled: ``tasks`` has doc_id, page_num, x0, y0, x1, y1 and may have r, g, b, pad."""

    def change(content: bytes, pages: dict[int, list[dict]]) -> bytes:
        doc = {p.number: p for p in Document(content).pages()}
        return append(content, {n: (rects_stream(doc[n], ts), set()) for n, ts in pages.items() if n in doc})

    return _changed(docs, tasks, change)


def save(docs: DataFrame, folder: str) -> None:
    """Write each document as ``<doc_id>.pdf`` in a folder that all executors share."""

    def write_rows(rows) -> None:
        from pathlib import Path

        Path(folder).mkdir(parents=True, exist_ok=True)
        for r in rows:
            part = Path(folder) / f".{r.doc_id}.part"
            part.write_bytes(bytes(r.content))
            part.replace(Path(folder) / f"{r.doc_id}.pdf")  # a task that runs again replaces whole files

    docs.select("doc_id", "content").foreachPartition(write_rows)
