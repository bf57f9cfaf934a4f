"""Builds small documents as bytes for the tests."""

from __future__ import annotations

import zlib

from vellum.sources.syntax import Name, Ref, Stream, write


class Maker:
    def __init__(self):
        self.objects: dict[int, object] = {}

    def add(self, value) -> Ref:
        self.objects[len(self.objects) + 1] = value
        return Ref(len(self.objects))

    def classic(self, root: Ref, **trailer) -> bytes:
        out, places = bytearray(b"%PDF-1.5\n"), {}
        for n, value in self.objects.items():
            places[n] = len(out)
            out += b"%d 0 obj\n" % n + write(value) + b"\nendobj\n"
        at = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1)
        for n in sorted(places):
            out += b"%010d 00000 n \n" % places[n]
        out += b"trailer\n" + write({"Size": len(places) + 1, "Root": root, **trailer}) + b"\nstartxref\n%d\n%%%%EOF\n" % at
        return bytes(out)

    def packed(self, root: Ref) -> bytes:
        """Plain objects in an object stream, an xref stream with a PNG predictor."""
        plain = {n: v for n, v in self.objects.items() if not isinstance(v, Stream)}
        body, head = b"", []
        for n, v in plain.items():
            head.append(f"{n} {len(body)}")
            body += write(v) + b" "
        first = " ".join(head).encode() + b" "
        bundle, xref = len(self.objects) + 1, len(self.objects) + 2
        out, rows = bytearray(b"%PDF-1.5\n"), {}
        streams = {n: v for n, v in self.objects.items() if isinstance(v, Stream)}
        streams[bundle] = Stream({"Type": Name("ObjStm"), "N": len(plain), "First": len(first), "Filter": Name("FlateDecode")}, zlib.compress(first + body))
        for n, v in streams.items():
            rows[n] = (1, len(out), 0)
            out += b"%d 0 obj\n" % n + write(v) + b"\nendobj\n"
        rows |= {n: (2, bundle, i) for i, n in enumerate(plain)} | {xref: (1, len(out), 0), 0: (0, 0, 255)}
        raw, above = b"", bytes(5)
        for n in range(xref + 1):
            kind, a, b = rows[n]
            row = bytes([kind]) + a.to_bytes(3, "big") + bytes([b])
            raw += b"\x02" + bytes(x - y & 255 for x, y in zip(row, above, strict=True))
            above = row
        info = {"Type": Name("XRef"), "Size": xref + 1, "W": [1, 3, 1], "Root": root, "Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 5}}
        out += b"%d 0 obj\n" % xref + write(Stream(info, zlib.compress(raw))) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % rows[xref][1]
        return bytes(out)


HELVETICA = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}


def build(pages: list[bytes], fonts: dict | None = None, how: str = "classic", page: dict | None = None, resources: dict | None = None, flate: bool = False, extra=None, **trailer) -> bytes:
    """A document with these content streams, one a page; ``extra`` may add objects and returns more resources."""
    m = Maker()
    font_refs = {k: m.add(v) for k, v in (fonts or {"F1": HELVETICA}).items()}
    more = extra(m) if extra else {}
    tree = {"Type": Name("Pages"), "Kids": [], "Count": len(pages), "MediaBox": [0, 0, 600, 800], "Resources": {"Font": font_refs, **(resources or {}), **more}}
    parent = m.add(tree)
    for content in pages:
        stream = Stream({"Filter": Name("FlateDecode")}, zlib.compress(content)) if flate else Stream({}, content)
        tree["Kids"].append(m.add({"Type": Name("Page"), "Parent": parent, "Contents": m.add(stream), **(page or {})}))
    root = m.add({"Type": Name("Catalog"), "Pages": parent})
    return m.classic(root, **trailer) if how == "classic" else m.packed(root)


def text(*lines: str, size: int = 10, x: int = 50, y: int = 700, step: int = 12, font: str = "F1") -> bytes:
    """A text object with a line under the other."""
    out = f"BT /{font} {size} Tf {size * 0 + step} TL {x} {y} Td "
    return (out + " ".join(f"({line}) Tj T*" for line in lines) + " ET").encode("latin-1")
