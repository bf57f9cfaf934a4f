"""Queries that go through document bytes: each text of the documents table is written as a file and read back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Rect
from ..sources import codec, encode, pdf, writer
from ..sources.syntax import Name, Ref, Stream, write

Query = Callable[[SparkSession, str], DataFrame]
LINES_PER_PAGE = 40
LEADING = 14


FORMS = ("plain", "packed", "damaged", "filtered", "drawn")


def document_bytes(text: str, form: str = "plain") -> bytes:
    """A document that shows the lines of a text, forty a page, in a fixed-width face.

    ``packed``: objects in an object stream, cross references in a stream under prediction; ``damaged``: no cross
    references at all; ``filtered``: contents under a chain of filters; ``drawn``: each page draws a form that holds its contents.
    """
    lines = text.split("\n")
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": Name("WinAnsiEncoding")}}
    fonts = {"Font": {"F1": Ref(3)}}
    kids = []
    for at in range(0, len(lines), LINES_PER_PAGE):
        body = b"BT /F1 10 Tf %d TL 20 780 Td\n" % LEADING + b"\n".join(write(x.encode("cp1252", "replace")) + b" Tj T*" for x in lines[at : at + LINES_PER_PAGE]) + b"\nET"
        n = 4 + (3 if form == "drawn" else 2) * len(kids)
        page: dict[str, object] = {"Type": Name("Page"), "Parent": Ref(2), "Contents": Ref(n)}
        if form == "filtered":
            objects[n] = Stream({"Filter": [Name(x) for x in CHAIN]}, encode.encode(body, list(CHAIN), [{}] * len(CHAIN)))
        elif form == "drawn":
            objects[n] = Stream({}, b"q 2 0 0 2 0 0 cm /Fm1 Do Q")
            objects[n + 2] = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 600, 800], "Matrix": [0.5, 0, 0, 0.5, 0, 0], "Resources": fonts}, body)
            page["Resources"] = {"XObject": {"Fm1": Ref(n + 2)}}
        else:
            objects[n] = Stream({}, body)
        objects[n + 1] = page
        kids.append(Ref(n + 1))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 600, 800], "Resources": {} if form == "drawn" else fonts}
    return _packed(objects) if form == "packed" else _plain(objects, damaged=form == "damaged")


CHAIN = ("ASCII85Decode", "LZWDecode", "RunLengthDecode")


def _placed(objects: dict[int, object]) -> tuple[bytearray, dict[int, int]]:
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for n in sorted(objects):
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + write(objects[n]) + b"\nendobj\n"
    return out, places


def _plain(objects: dict[int, object], damaged: bool = False) -> bytes:
    out, places = _placed(objects)
    at = len(out)
    if damaged:
        return bytes(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places.values())
    return bytes(out + b"trailer\n" + write({"Size": len(places) + 1, "Root": Ref(1)}) + b"\nstartxref\n%d\n%%%%EOF\n" % at)


def _packed(objects: dict[int, object]) -> bytes:
    """Objects that are no streams in an object stream, cross references as a stream."""
    inner = {n: write(v) for n, v in objects.items() if not isinstance(v, Stream)}
    starts = np.cumsum([0, *(len(x) + 1 for x in inner.values())]).tolist()
    head = b" ".join(b"%d %d" % x for x in zip(inner, starts, strict=False)) + b" "
    bundle = max(objects) + 1
    streams = {n: v for n, v in objects.items() if isinstance(v, Stream)}
    streams[bundle] = Stream({"Type": Name("ObjStm"), "N": len(inner), "First": len(head), "Filter": Name("FlateDecode")}, encode.encode(head + b" ".join(inner.values()), ["FlateDecode"], [{}]))
    out, places = _placed(streams)
    xref = bundle + 1
    entry = {0: (0, 0, 0), xref: (1, len(out), 0)} | {n: (1, at, 0) for n, at in places.items()} | {n: (2, bundle, i) for i, n in enumerate(inner)}
    rows = b"".join(bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for kind, a, b in (entry[n] for n in range(xref + 1)))
    parms = {"Predictor": 12, "Columns": 7}
    info = {"Type": Name("XRef"), "Size": xref + 1, "W": [1, 4, 2], "Root": Ref(1), "Filter": Name("FlateDecode"), "DecodeParms": parms}
    return bytes(out + b"%d 0 obj\n" % xref + write(Stream(info, encode.encode(rows, ["FlateDecode"], [parms]))) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % len(out))


#: Files that are made at a time.
BATCH = 100
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _written(forms: tuple[str, ...]) -> Step:
    """Batches of (doc_id, content) of (doc_id, text); a document's number picks its form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, BATCH) for at in range(0, whole.num_rows, BATCH)):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([document_bytes(t or "", forms[(d or 0) % len(forms)]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.binary())], ["doc_id", "content"])

    return run


def _spread(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").repartition(docs.sparkSession.sparkContext.defaultParallelism)  # parsing costs far more than moving texts


def as_files(docs: DataFrame, forms: tuple[str, ...] = FORMS[:1]) -> DataFrame:
    """(doc_id, content) of (doc_id, text) rows; a document's number picks its form."""
    return _spread(docs).mapInArrow(_written(forms), "doc_id long, content binary")


def _texts(spark: SparkSession, sf_dir: str, *steps: Step) -> DataFrame:
    """Page texts of files that these steps make of the documents, one after the other within a task: some files at a time, and none leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in (*steps, pdf.text_batches):
            batches = step(batches)
        return batches

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long"))
    return _spread(docs).mapInArrow(run, pdf.PAGE_TEXTS)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LINES = f"""lines as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as line_no, unnest(string_split(text, chr(10))) as line from documents),
placed as (select doc_id, line_no // {LINES_PER_PAGE} as page_num, line_no, line from lines where line <> '')"""
_SHOWN = "string_agg(case when line like '%-' then left(line, length(line) - 1) else line || chr(10) end, '' order by line_no)"


def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts read from the files."""
    return _texts(spark, sf_dir, _written(FORMS[:1]))


def pdf_redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts after the first two lines of every even page are redacted and the files are written and read again."""
    top = [Rect(0.0, 0.0, 1e9, 20.0 + LEADING - 5)]
    return _texts(spark, sf_dir, _written(FORMS[:1]), writer.redactor(lambda page_num: top if page_num % 2 == 0 else []))


def pdf_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and objects of each file."""
    files = _files(spark, sf_dir)
    pages = pdf.pages(files).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.max("width").alias("width"))
    return pages.join(pdf.objects(files).groupBy("doc_id").agg(F.count("*").alias("n_objects")), "doc_id")


def pdf_form_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts read from files of five forms: object streams, lost cross references, chains of filters, nested forms."""
    return _texts(spark, sf_dir, _written(FORMS))


#: Filters and parameters that every text goes through.
CODINGS: dict[str, tuple[list[str], list[dict]]] = {
    **{name: ([name], [{}]) for name in encode.FILTERS},
    "late LZWDecode": (["LZWDecode"], [{"EarlyChange": 0}]),
    **{f"predictor {p}": (["FlateDecode"], [{"Predictor": p, "Columns": 16}]) for p in (2, 10, 11, 12, 13, 14)},
    "chain": (["ASCIIHexDecode", "ASCII85Decode", "FlateDecode"], [{}, {}, {"Predictor": 15, "Columns": 5}]),
}


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for coding, (names, parms) in CODINGS.items():
            back = [codec.decode(encode.encode((t or "").encode("utf-8", "surrogatepass"), names, parms), names, parms)[0] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([coding] * len(ids)), pa.array([len(x) for x in back], pa.int64()), pa.array(back, pa.binary())], ["doc_id", "coding", "n_bytes", "data"])


def stream_codings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of each text after it went through each filter and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id as bigint) as doc_id", "text").repartition(spark.sparkContext.defaultParallelism)
    return docs.mapInArrow(_coded, "doc_id long, coding string, n_bytes long, data binary").select("doc_id", "coding", "n_bytes", F.md5("data").alias("digest"))


QUERIES: dict[str, Query] = {"pdf_text": pdf_text, "pdf_redacted_text": pdf_redacted_text, "pdf_page_count": pdf_page_count, "pdf_form_text": pdf_form_text, "stream_codings": stream_codings}

ORACLES = {
    "pdf_text": f"with {_LINES} select doc_id, page_num, {_SHOWN} as text from placed group by all",
    "pdf_redacted_text": f"with {_LINES} select doc_id, page_num, {_SHOWN} as text from placed where not (page_num % 2 = 0 and line_no % {LINES_PER_PAGE} < 2) group by all",
    "pdf_page_count": f"""with n as (select doc_id, len(string_split(coalesce(text, ''), chr(10))) as n from documents)
select doc_id, (n + {LINES_PER_PAGE - 1}) // {LINES_PER_PAGE} as n_pages, 600.0::double as width, 3 + 2 * ((n + {LINES_PER_PAGE - 1}) // {LINES_PER_PAGE}) as n_objects from n""",
    "pdf_form_text": f"with {_LINES} select doc_id, page_num, {_SHOWN} as text from placed group by all",
    "stream_codings": f"""select doc_id, coding, octet_length(encode(coalesce(text, '')))::bigint as n_bytes, md5(coalesce(text, '')) as digest
from documents cross join (values {", ".join(f"('{c}')" for c in CODINGS)}) codings(coding)""",
}
